"""Sweeps, hierarchies, survival, rules across rows and differences, against plain Python."""

import datetime as dt
import random
import shutil
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spanworks.operators import hierarchy, quality, survival
from spanworks.operators.sweep import Spans, episodes_from_many, overlay_sources
from spanworks.sinks.differences import differing_leaves, read_keyed, snapshot_diff, write_keyed
from tests.compare import rows_of

DAY = dt.date(2020, 1, 1)
AS_OF = DAY + dt.timedelta(days=150)
SPAN = "k int, id int, s date, e date, v string, w int"


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def some_spans(spark, seed, n=140):
    """Overlaps, gaps, equal starts, open and empty spans, spans past the end; one key holds most."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = rng.randrange(160)
        e = None if rng.random() < 0.08 else s + rng.choice([0, 1, 2, 5, 20, 60, -3])
        rows.append((rng.choice([1, 1, 1, 2, None, 3 + i % 4]), i, day(s), day(e), rng.choice(["a", "b", None]), rng.choice([1, 2, None])))
    return spark.createDataFrame(rows, SPAN), rows


def holders(rows):
    """(key, day) -> the row that holds it."""
    out = {}
    for row in rows:
        k, i, s, e, *_ = row
        d = s
        while d < min(e or AS_OF, AS_OF):
            if (k, d) not in out or (out[k, d][2], out[k, d][1]) < (s, i):
                out[k, d] = row
            d += dt.timedelta(days=1)
    return out


def runs(days):
    """(key, first day, day after the last, value) of the longest runs of equal values."""
    out = []
    for k, d in sorted(days, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        value = days[k, d]
        if out and out[-1][0] == k and out[-1][2] == d and out[-1][3] == value:
            out[-1][2] = d + dt.timedelta(days=1)
        else:
            out.append([k, d, d + dt.timedelta(days=1), value])
    return [tuple(r) for r in out]


@pytest.mark.parametrize("pieces", [None, 5])
def test_episodes_from_many(spark, pieces):
    made = [some_spans(spark, seed) for seed in (1, 2, 3)]
    held = [holders(rows) for _, rows in made]
    days = {}
    for place in {p for h in held for p in h}:
        rows = [h.get(place) for h in held]
        first, second, third = (r and (r[4], r[5]) for r in rows)
        days[place] = (
            first and first[0], second and second[0], second and second[1], third and third[1],
            [n for n, r in zip("xyz", rows) if r])
    tables = {
        "x": Spans(made[0][0].withColumnRenamed("v", "v1"), "s", "e", "id", ["v1"]),
        "y": Spans(made[1][0].withColumnsRenamed({"v": "v2", "w": "w2"}), "s", "e", "id", ["v2", "w2"]),
        "z": Spans(made[2][0].withColumnRenamed("w", "w3"), "s", "e", "id", ["w3"]),
    }
    got = episodes_from_many(tables, ["k"], str(AS_OF), pieces)
    assert got.columns == ["k", "start_date", "end_date", "v1", "v2", "w2", "w3", "valid_in"]
    assert rows_of(got.columns, got.collect()) == rows_of(got.columns, [(k, a, b, *v) for k, a, b, v in runs(days)])


def test_one_table_equals_its_own_ranges(spark):
    df, rows = some_spans(spark, 9)
    got = episodes_from_many({"x": Spans(df, "s", "e", "id", ["id"])}, ["k"], str(AS_OF))
    want = [(k, a, b, v) for k, a, b, v in runs({p: r[1] for p, r in holders(rows).items()})]
    assert rows_of(["k", "a", "b", "id"], [(r.k, r.start_date, r.end_date, r.id) for r in got.collect()]) == rows_of(["k", "a", "b", "id"], want)


def test_overlay_sources(spark):
    made = [some_spans(spark, seed) for seed in (4, 5, 6)]
    held = [holders(rows) for _, rows in made]
    days = {}
    for place in {p for h in held for p in h}:
        values = []
        for column in (4, 5):
            given = [(n, h[place][column]) for n, h in zip("xyz", held) if place in h and h[place][column] is not None]
            values += [given[0][1], given[0][0]] if given else [None, None]
        days[place] = tuple(values)
    got = overlay_sources({n: Spans(df, "s", "e", "id", ["v", "w"]) for n, (df, _) in zip("xyz", made)}, ["k"], str(AS_OF))
    assert got.columns == ["k", "start_date", "end_date", "v", "v_source", "w", "w_source"]
    assert rows_of(got.columns, got.collect()) == rows_of(got.columns, [(k, a, b, *v) for k, a, b, v in runs(days)])


def test_sweeps_of_empty_tables_and_wrong_names(spark):
    empty = spark.createDataFrame([], SPAN)
    df, _ = some_spans(spark, 7)
    assert episodes_from_many({"x": Spans(empty, "s", "e", "id", ["v"])}, ["k"], str(AS_OF)).count() == 0
    both = overlay_sources({"x": Spans(empty, "s", "e", "id", ["v"]), "y": Spans(df, "s", "e", "id", ["v"])}, ["k"], str(AS_OF))
    assert both.filter("v_source = 'x'").count() == 0 and both.count() > 0
    with pytest.raises(ValueError, match="occur twice"):
        episodes_from_many({n: Spans(df, "s", "e", "id", ["v"]) for n in "xy"}, ["k"], str(AS_OF))
    with pytest.raises(ValueError, match="same values"):
        overlay_sources({"x": Spans(df, "s", "e", "id", ["v"]), "y": Spans(df, "s", "e", "id", ["v", "w"])}, ["k"], str(AS_OF))


def rollup_by_hand(edges, own):
    """edges: (key, child) -> parent; own: (key, node) -> amount."""
    loops = set()
    for key, node in edges:
        at = edges.get((key, node))
        for _ in range(len(edges)):
            if at == node:
                loops.add((key, node))
                break
            at = edges.get((key, at))
            if at is None:
                break
    people = {p for p in edges} | {(k, up) for (k, _), up in edges.items()} | set(own)
    out = {p: [0, 0, None] for p in people}
    for key, node in people:
        at, depth = node, 0
        while True:
            total = out[key, at]
            total[0] += 1
            total[1] = max(total[1], depth)
            if (key, node) in own:
                total[2] = (total[2] or 0) + own[key, node]
            if (key, at) in loops or (key, at) not in edges:
                break
            at, depth = edges[key, at], depth + 1
    return loops, out


def test_hierarchy(spark):
    """Random forests with loops of several lengths, a deep chain, a node above most, null keys and repeated rows."""
    rng = random.Random(8)
    rows = [("a", n, rng.randrange(0, n)) for n in range(1, 60)] + [("b", n, n - 1) for n in range(1, 70)]
    rows += [(None, n, 0) for n in range(1, 80)] + [(None, 0, 500)]
    rows += [("c", 1, 1), ("c", 2, 3), ("c", 3, 2), ("c", 4, 2), ("c", 5, 4), ("c", 10, 11), ("c", 11, 12), ("c", 12, 13), ("c", 13, 10), ("c", 9, 12)]
    rows += [("a", 5, None), ("a", None, 5), rows[3], ("b", 7, 30)]  # of two parents the least counts
    relations = spark.createDataFrame(rows, "p string, child int, boss int")
    edges = {}
    for p, c, b in rows:
        if c is not None and b is not None:
            edges[p, c] = min(b, edges.get((p, c), b))
    own = {(p, n): Decimal(rng.randrange(1000)) / 100 for p in ("a", "b", "c", None) for n in range(0, 90, 2)}
    amounts = spark.createDataFrame([(p, n, v) for (p, n), v in own.items()], "p string, node int, pay decimal(10,2)")
    loops, totals = rollup_by_hand(edges, own)
    got = hierarchy.team_rollup(relations, "child", "boss", amounts, "node", ["pay"], ["p"]).collect()
    assert {(r.p, r.node): (r.members, r.levels, r.pay) for r in got} == {p: tuple(v) for p, v in totals.items()} and len(got) == len(totals)
    found = {(r.p, r.node): (r.cycle, r.length) for r in hierarchy.cycles(relations, "child", "boss", ["p"]).collect()}
    assert set(found) == loops
    assert found["c", 1] == (1, 1) and found["c", 3] == (2, 2) and found["c", 13] == (10, 4)


def test_hierarchy_without_keys_or_rows(spark):
    relations = spark.createDataFrame([("x", "y"), ("y", "z")], "c string, b string")
    amounts = spark.createDataFrame([("x", 1), ("z", 5), (None, 7)], "n string, v long")
    got = {r.n: (r.members, r.levels, r.v) for r in hierarchy.team_rollup(relations, "c", "b", amounts, "n", ["v"]).collect()}
    assert got == {"x": (1, 0, 1), "y": (2, 1, 1), "z": (3, 2, 6)}
    assert hierarchy.cycles(relations, "c", "b").count() == 0
    assert hierarchy.team_rollup(relations.limit(0), "c", "b", amounts.limit(0), "n", ["v"]).count() == 0


def test_survival(spark):
    """Gaps, delayed rows, a covariate that changes, every kind of leaving and none."""
    rng = random.Random(2)
    rows, weekly = [], []
    for person in range(60):
        week, n = rng.randrange(20), rng.randrange(1, 5)
        mine = []
        for k in range(n):
            long = rng.randrange(1, 9)
            mine.append((person, week, week + long - 1, rng.choice("xy"), rng.choice(["Vol", "Inv", "Unk", None, "Odd"]) if k == n - 1 or rng.random() < 0.3 else None))
            week += long + rng.choice([0, 0, 3])
        rows += mine
        weekly += [(w - mine[0][1], c, t if b == mine[-1][2] and w == b else "still", t) for _, a, b, c, t in mine for w in range(a, b + 1)]
    monday = dt.date(2020, 1, 6)
    episodes = spark.createDataFrame(
        [(p, monday + dt.timedelta(weeks=a), monday + dt.timedelta(weeks=b), c, t) for p, a, b, c, t in rows],
        "person int, start_date date, end_week_date date, grade string, term_type string")
    want = defaultdict(lambda: [0, 0, 0, 0, 0])
    for week, grade, leaves, _ in weekly:
        cell = want[grade, week]
        cell[0] += 1
        if leaves != "still":
            cell[1 + ["Vol", "Inv", "Unk"].index(leaves) if leaves in ("Vol", "Inv", "Unk") else 4] += 1
    risk = survival.risk_sets(episodes, ["person"], ["grade"])
    assert {(r.grade, r.week): [r.at_risk, r.left_vol, r.left_inv, r.left_unk, r.censored] for r in risk.collect()} == dict(want)
    everyone = survival.cumulative_incidence(survival.risk_sets(episodes, ["person"])).orderBy("week").collect()
    still, sums = 1.0, [0.0, 0.0, 0.0]
    for r in everyone:
        cell = [sum(v[i] for (_, w), v in want.items() if w == r.week) for i in range(5)]
        sums = [s + still * cell[1 + i] / cell[0] for i, s in enumerate(sums)]
        still *= 1 - sum(cell[1:4]) / cell[0]
        assert r.at_risk == cell[0] and abs(r.survival - still) < 1e-12
        assert all(abs(a - b) < 1e-12 for a, b in zip(sums, (r.incidence_vol, r.incidence_inv, r.incidence_unk)))
        assert abs(r.survival + sum(sums) - 1) < 1e-9
    assert survival.cumulative_incidence(survival.risk_sets(episodes.limit(0), ["person"])).count() == 0


@pytest.mark.parametrize("pieces", [None, 6])
def test_span_rules(spark, pieces):
    df, rows = some_spans(spark, 11, 200)
    rows = rows + [(1, 900, None, day(3), "a", 1)]
    df = df.unionByName(spark.createDataFrame(rows[-1:], SPAN))
    want = []
    for k, i, s, e, *_ in rows:
        if s is None:
            continue
        if e is not None and e < s:
            want.append((k, i, "order", i, (s - e).days))
            continue
        earlier = [(b is None, b or dt.date.min, j) for q, j, a, b, *_ in rows if q == k and a and (b is None or b >= a) and (a, j) < (s, i)]
        if not earlier:
            continue
        is_open, reach, j = max(earlier)
        if is_open or s < reach:
            ends = [x for x in (e, None if is_open else reach) if x]
            want.append((k, i, "overlap", j, (min(ends) - s).days if ends else None))
        elif (s - reach).days > 4:
            want.append((k, i, "gap", j, (s - reach).days))
    got = quality.span_rules(df, ["k"], "s", "e", "id", 4, pieces)
    assert rows_of(got.columns, got.collect()) == rows_of(["k", "id", "rule", "witness", "days"], want)
    assert {w[2] for w in want} == {"order", "overlap", "gap"}


ROWS = "k int, _bucket string, v double, items array<int>, w string"


def test_snapshot_diff(spark, tmp_path):
    """Cells, copies of a key, null keys and values; what is equal need not even be there."""
    rows = [(i, "b", float(i), [i], "same") for i in range(3000)] + [(None, "b", 1.0, None, None), (7, "b", 7.5, [1], "copy")]
    after = [r for r in rows if r[0] not in (10, 11)]
    after = [(k, b, v + 1, x, None) if k == 20 else (k, b, v, [0, None], w) if k == 21 else (k, b, v, x, w) for k, b, v, x, w in after]
    after += [(4000, None, None, None, "new"), (None, "b", 2.0, None, None)]
    random.Random(1).shuffle(after)
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    first, second = spark.createDataFrame(rows, ROWS), spark.createDataFrame(after, ROWS)
    write_keyed(first, a, ["k"])
    write_keyed(second, b, ["k"])
    got = snapshot_diff(spark, a, b, first.schema, ["k"])
    assert got.columns == ["k", "copy", "change", "column", "before", "after"]
    said = rows_of(got.columns, got.collect())
    assert said == rows_of(got.columns, [
        (10, 1, "removed", None, None, None), (11, 1, "removed", None, None, None), (4000, 1, "added", None, None, None),
        (20, 1, "changed", "v", "20.0", "21.0"), (20, 1, "changed", "w", "same", None), (21, 1, "changed", "items", "[21]", "[0,null]"),
        *[r for r in [tuple(x) for x in got.filter("k is null").collect()]]])
    assert {(r.change, r.column) for r in got.filter("k is null").collect()} in ({("added", None)}, {("added", None), ("changed", "v")})
    leaves = {r.bucket for r in differing_leaves(spark, a, b).collect()}
    assert 0 < len(leaves) < 8
    for path in (tmp_path / "a", tmp_path / "b"):
        for folder in (path / "rows").iterdir():
            if "=" in folder.name and int(folder.name.split("=")[1]) not in leaves:
                shutil.move(folder, tmp_path / f"gone-{path.name}-{folder.name}")
    again = snapshot_diff(spark, a, b, first.schema, ["k"])
    assert rows_of(again.columns, again.collect()) == said


def test_snapshots_that_agree(spark, tmp_path):
    df = spark.createDataFrame([(i, "b", 0.5, [i], "x") for i in range(50)], ROWS)
    a, b, c = (f"file://{tmp_path}/{x}" for x in "abc")
    write_keyed(df, a, ["k"])
    write_keyed(df.repartition(7), b, ["k"])
    write_keyed(df.limit(0), c, ["k"])
    assert snapshot_diff(spark, a, b, df.schema, ["k"]).count() == 0
    assert snapshot_diff(spark, c, c, df.schema, ["k"]).count() == 0
    assert {r.change for r in snapshot_diff(spark, a, c, df.schema, ["k"]).collect()} == {"removed"}
    assert read_keyed(spark, a, df.schema).exceptAll(df).count() == 0
    with pytest.raises(ValueError, match="must not be named"):
        snapshot_diff(spark, a, b, df.withColumnRenamed("k", "copy").schema, ["copy"])
