"""Hard negatives: brute force, ties, large and awkward rows."""

import math
import random

import numpy as np
import pytest

from spanworks.llm import hard_negatives
from spanworks.llm.hard_negatives import mine

VECTORS = "vec_id long, embedding array<float>, label int, anchor int, key string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.7) for c in centres[i % 6]], rng.randrange(4), 1, "k") for i in range(500)]
    rows += [(i, [0.5] * 8, i % 3, 1, "k") for i in range(500, 660)]  # ties, positives and negatives
    rows += [(i, [0.0] * 8, i % 2, 1, "k") for i in range(680, 720)]  # scores of zero
    rows += [(800, None, 1, 1, "k"), (801, [1.0, None], 1, 1, "k"), (900, [math.nan] * 8, 1, 1, "k"), (1000, [1.0] * 8, None, 1, "k")]
    rows += [(1100, [], 1, 1, "k"), (1200, [2.0, 3.0], 1, 1, "k"), (None, [1.0] * 8, 1, 1, "k"), (1300, [-x for x in centres[0]], 9, 1, "k")]
    rows += [rows[0], rows[33], rows[100], (100, rows[7][1], 3, 1, "k"), (-200, rows[11][1], 2, 1, "k")]
    return spark.createDataFrame(rows, VECTORS)


def by_force(rows, step, positives=5, negatives=10, low=30, high=90):
    numbers = [
        (i, label, [math.floor(256 * v) for v in x]) for i, x, label in rows
        if i is not None and label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x)
    ]
    pad = max([len(x) for *_, x in numbers], default=0)
    numbers = [(i, label, x + [0] * (pad - len(x))) for i, label, x in numbers]
    out = []
    for a in sorted({i for i, *_ in numbers if math.fmod(i, step) == 0}):
        _, label, x = min((n for n in numbers if n[0] == a), key=lambda n: (n[1], np.array(n[2], "<i8").tobytes()))
        scored = sorted((-sum(p * q for p, q in zip(x, v)), i, other) for i, other, v in numbers if i != a)
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and low * -score <= 100 * -s[0] <= high * -score]
            out += [(a, p, n, i, -score, -s) for n, (s, i, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("group,block,step", [(8192, 128, 100), (64, 3, 20), (7, 1000, 100)])
def test_against_force(vectors, group, block, step):
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    got = sorted(tuple(r) for r in mine(vectors, step=step, group=group, block=block).collect())
    want = by_force(rows, step)
    assert got == want and len(want) > 100


def test_other_windows(vectors):
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    got = mine(vectors, positives=2, negatives=3, step=50, low=0, high=100, group=100).collect()
    assert sorted(map(tuple, got)) == by_force(rows, 50, 2, 3, 0, 100)


def test_long_vectors(spark):
    """Scores beyond the whole numbers of a double are still exact; beyond 62 bits they are refused."""
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-10**6, 10**6)) for _ in range(6)], i % 2, 1, "k") for i in range(60)]
    df = spark.createDataFrame(rows, VECTORS)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(map(tuple, mine(df, step=10, group=16).collect())) == by_force(rows, 10)
    with pytest.raises(Exception, match="too long for scores"):
        mine(spark.createDataFrame([(0, [1e30], 1, 1, "k")], VECTORS)).collect()


def test_empty_and_few(spark):
    assert mine(spark.createDataFrame([], VECTORS)).collect() == []
    assert mine(spark.createDataFrame([(100, [1.0], 1, 1, "k")], VECTORS)).collect() == []
    assert mine(spark.createDataFrame([(100, [1.0], 1, 1, "k"), (1, [1.0], 1, 1, "k")], VECTORS)).collect() == []


def test_order_of_keys():
    rng = np.random.default_rng(1)
    rows = [(int(a), int(s), int(o), int(i)) for a, s, o, i in rng.integers(-3, 3, (400, 4)) for o in [abs(o) % 2]]
    keys = [hard_negatives.pack(np.array([a]), np.array([s]), o, np.array([i]))[0].as_py() for a, s, o, i in rows]
    assert [rows[k] for k in np.argsort(np.array(keys, object), kind="stable")] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_first_of_rows():
    rng = np.random.default_rng(2)
    scores, allowed = rng.integers(-4, 5, (30, 40)), rng.random((30, 40)) < 0.4
    fast, slow = (hard_negatives.first_of_rows(scores, allowed, 6, packs) for packs in (True, False))
    assert (fast == slow).all() and (fast.sum(1) == np.minimum(6, allowed.sum(1))).all()
