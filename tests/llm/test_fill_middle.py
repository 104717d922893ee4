"""Fill-in-the-middle: brute force, exact restoring, and awkward rows."""

import hashlib
import random
import re

import pyarrow as pa
import pytest

from spanworks.llm import fill_middle
from spanworks.llm.fill_middle import PieceTable

DOCS = "doc_id long, text string, output string, n int"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def by_force(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    letters = ["a", "Ä", "水", "😀", " ", "\n", "\t", "\r", "\x0b", "\x0c", " ", " ", "<", ">", "P", "S", "M"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(600)]
    texts += [None, "", " ", " \n", "one", "one ", " one", "<P>", "a <S> b", "x<M>", "<<S", ">P", "w " * 200_000, "é" * 300_000]
    texts += ["same text here"] * 50
    out = [(k, t, "kept", 1) for k, t in enumerate(texts)]
    return out + [(None, "no id at all", "x", 2), (3, "a repeated id", None, None), (-7, "a negative id", "x", 2)] + out[:5]


def test_against_force(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n, r.form, r.prefix_chars or -1, r.middle_chars or -1, r.output)
                 for r in fill_middle.transform(docs).collect())
    want = []
    for doc_id, text, *_ in rows:
        n, form, prefix, middle, output = by_force(doc_id, text)
        want.append((doc_id is None, doc_id or 0, n, form, prefix or -1, middle or -1, output))
    assert got == sorted(want)
    assert {form for _, _, _, form, *_ in want} == {"plain", "psm", "spm"}


def test_restored(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    back = fill_middle.restore(fill_middle.transform(docs)).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(map(tuple, back), key=order) == sorted(((i, t or "") for i, t, *_ in rows), key=order)


def test_digests_are_those_of_the_outputs(spark, rows):
    docs = spark.createDataFrame(rows, DOCS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = sorted((r.form, r.output_sha256, r.restored_sha256) for r in fill_middle.digests(docs).collect())
    assert got == sorted((by_force(i, t)[1], sha(by_force(i, t)[4]), sha(t or "")) for i, t, *_ in rows)


def test_every_form_restores(spark, rows):
    """Also where every text that can be is transformed, and where the suffix never comes first."""
    docs = spark.createDataFrame(rows, DOCS)
    for rate, first in ((100, 100), (100, 0), (0, 50)):
        out = fill_middle.transform(docs, rate, first)
        assert {r.form for r in out.select("form").distinct().collect()} <= ({"plain"} if rate == 0 else {"plain", "spm" if first else "psm"})
        assert fill_middle.restore(out).exceptAll(docs.selectExpr("doc_id", "coalesce(text, '')")).count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert fill_middle.digests(empty).collect() == [] and fill_middle.restore(fill_middle.transform(empty)).collect() == []


def test_piece_table():
    text = b"prefix middle suffix"
    table = PieceTable.of(text).cut([6, 6, 13])
    assert [bytes(p) for p in table.stream()] == [b"prefix", b"", b" middle", b" suffix"]
    assert table.cut([2, 10]).content() == text
    assert table.arranged([3, 2, 1, 0]).sha256() == hashlib.sha256(b" suffix middleprefix").hexdigest()
    assert all(b is text or b == b"<P><S><M>" for b in table.buffers)
    order = fill_middle.ORDERS["spm"]
    assert [order[k] for k in fill_middle.inverse(order)] == list(range(6))


def test_sliced_column():
    column = pa.array(["zero", "one two three", None, "four five"]).slice(1)
    chosen = list(fill_middle.choose([1, 2, 3], column, rate=100))
    assert [bytes(c.text) for c in chosen] == [b"one two three", b"", b"four five"] and [c.units for c in chosen] == [3, 0, 2]
