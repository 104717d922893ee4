"""Keys, inclusions, merged profiles, trailing windows and corrections, against plain Python."""

import datetime as dt
import random
from collections import Counter
from itertools import combinations
from statistics import median

import pytest
from pyspark.sql import functions as F

from spanworks.operators import keys, profiles, teams, weeks
from spanworks.sinks.corrections import correct, read_known, write_known
from tests.compare import rows_of


def minimal_by_hand(names, rows, largest):
    found = []
    for size in range(1, largest + 1):
        for s in combinations(range(len(names)), size):
            cells = [tuple(r[i] for i in s) for r in rows]
            if all(c is not None for x in cells for c in x) and len(set(cells)) == len(rows) and not any(set(f) <= set(s) for f in found):
                found.append(s)
    return {", ".join(names[i] for i in s) for s in found}


def test_minimal_keys(spark):
    rng = random.Random(1)
    rows = [(i // 20, i % 20, i if i != 7 else None, rng.random(), f"t{i % 3}", [i], i // 40 if i % 2 else -1) for i in range(400)]
    names = ["a", "b c", "n", "x", "t", "l", "z"]
    df = spark.createDataFrame(rows, "a int, `b c` int, n int, x double, t string, l array<int>, z int")
    flat = [r[:5] + r[6:] for r in rows]
    for largest in (1, 2, 3):
        got = {r.key_columns for r in keys.minimal_keys(df, largest).collect()}
        assert got == minimal_by_hand([n for n in names if n != "l"], flat, largest)
    assert {r.key_columns for r in keys.minimal_keys(df.drop("x"), 3).collect()} == {"a, b c"}
    assert keys.minimal_keys(df.limit(1)).count() == 0 and keys.minimal_keys(df.limit(0)).count() == 0
    assert keys.minimal_keys(df.unionAll(df), 3).count() == 0


def test_inclusions(spark):
    numbers = spark.range(3000).selectExpr("id", "id % 7 as small", "if(id = 5, 99999, id) as off", "cast(null as int) as none", "cast(id as string) as name")
    some = spark.createDataFrame([(1, "1", 3000), (2, "zz", None), (None, "3", 2)], "ref int, label string, beyond int")
    got = keys.inclusions(spark, {"numbers": numbers, "some": some}, {"numbers": "id"})
    assert {tuple(r) for r in got.collect()} == {("numbers", "small", "numbers", "id"), ("some", "ref", "numbers", "id")}
    texts = keys.inclusions(spark, {"numbers": numbers, "some": some.filter("label <> 'zz'")}, {"numbers": "name"})
    assert {tuple(r)[:2] for r in texts.collect()} == {("some", "label")}


def test_profile_of_parts_is_that_of_the_whole(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "", " ", "often", "often", f"v{rng.randrange(500)}"]), rng.gauss(0, 9) if i % 10 else None, dt.date(2020, 1, 1) + dt.timedelta(days=i % 50), [i])
            for i in range(5000)]
    df = spark.createDataFrame(rows, "id int, t string, x double, d date, l array<int>")
    profiles.states(df, F.concat(F.lit("p"), F.col("id") % 9)).write.parquet(f"{tmp_path}/states")
    profiles.states(df.filter("id < 0"), F.lit("empty")).write.mode("append").parquet(f"{tmp_path}/states")
    got = {r.column_name: r for r in profiles.merged(spark.read.parquet(f"{tmp_path}/states")).collect()}
    whole = {r.column_name: r for r in profiles.merged(profiles.states(df)).collect()}
    assert set(got) == set(whole) == {"id", "t", "x", "d"}
    texts = [r[1] for r in rows]
    assert (got["t"].n_rows, got["t"].nulls, got["t"].blanks) == (5000, texts.count(None), texts.count("") + texts.count(" "))
    assert (got["id"].least, got["id"].largest) == (0, 4999) and got["t"].least is None and got["d"].least_text == "2020-01-01"
    exact = {"id": 5000, "t": len(set(texts) - {None}), "x": 4500, "d": 50}
    for side in (got, whole):
        assert all(abs(side[c].n_distinct - n) <= 0.05 * n for c, n in exact.items())
        for c, values in (("id", [r[0] for r in rows]), ("x", [r[2] for r in rows if r[2] is not None])):
            for q, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
                assert abs(sum(v <= side[c][name] for v in values) - q * len(values)) <= 0.01 * len(values) + 1
        top = Counter(t for t in texts if t is not None).most_common(3)
        assert abs(side["t"].frequent[0].n - top[0][1]) <= 5 and side["t"].frequent[0].value == "often"
    assert profiles.merged(profiles.states(df.limit(0))).count() == 0


def test_team_trailing(spark):
    rng = random.Random(4)
    monday = dt.date(2020, 1, 6)
    rows, weekly = [], Counter()
    present = set()
    for person in range(30):
        week = rng.randrange(30)
        for _ in range(rng.randrange(1, 4)):
            long, boss = rng.randrange(1, 12), rng.choice(["a", "a", "b", None])
            rows.append((boss, person, monday + dt.timedelta(weeks=week), monday + dt.timedelta(weeks=week + long - 1)))
            present |= {(boss, person, w) for w in range(week, week + long)}
            week += long + rng.choice([0, 1, 4, 9, 30])
    counts = Counter((b, w) for b, _, w in present)
    left = {k: rng.randrange(3) for k in counts}
    weekly = spark.createDataFrame([(b, monday + dt.timedelta(weeks=w), n, left[b, w]) for (b, w), n in counts.items()], "boss string, week_start date, headcount long, leavers long")
    ranges = spark.createDataFrame(rows, "boss string, person int, start_week date, end_week date")
    got = {(r.boss, (r.week_start - monday).days // 7): r for r in teams.team_trailing(ranges, weekly, ["boss"], "person", 8).collect()}
    assert set(got) == set(counts)
    for (boss, w), r in got.items():
        inside = [n for (b, v), n in counts.items() if b == boss and w - 7 <= v <= w]
        leavers = sum(n for (b, v), n in left.items() if b == boss and w - 7 <= v <= w)
        assert r.heads == len({p for b, p, v in present if b == boss and w - 7 <= v <= w})
        assert (r.leavers, r.median_headcount) == (leavers, median(inside))
        assert abs(r.mean_headcount - sum(inside) / len(inside)) < 1e-12 and abs(r.turnover - leavers * len(inside) / sum(inside)) < 1e-12


SPANS = "who int, span int, s date, e date, job string"


def build(spans):
    return weeks.start_stop_from_spans(spans, ["who"], "s", "e", "span", "2022-01-01", ["job"])


def test_corrections(spark, tmp_path):
    """Equal to a full build; folders of other buckets keep their files; entities appear and go; unchanged rows keep their date."""
    rng = random.Random(6)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    rows = [(None if i % 40 == 0 else i % 40, i, day(20 * (i // 40)), day(20 * (i // 40) + rng.randrange(5, 40)), rng.choice("xyz")) for i in range(400)]
    path = f"file://{tmp_path}/table"
    write_known(build(spark.createDataFrame(rows, SPANS)), path, ["who"], "2021-01-01", 8)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    now = [r if r[0] != 3 else (*r[:4], "new") for r in rows if r[0] != 5] + [(77, 900, day(1), None, "x")]
    now = [r if r[1] != 80 else (*r[:3], day(300), r[4]) for r in now]  # of the null key
    spans = spark.createDataFrame(now, SPANS)
    changed = spark.createDataFrame([(3,), (5,), (77,), (None,), (3,), (8,)], "who int")
    hit = correct(path, spans, changed, build, ["who"], "2021-06-01", 8)
    schema = build(spans).schema
    table = read_known(spark, path, schema)
    assert rows_of(schema.names, table.drop("known_at").collect()) == rows_of(schema.names, build(spans).collect())
    dates = {(r.who, str(r.known_at)) for r in table.select("who", "known_at").distinct().collect()}
    assert (3, "2021-01-01") not in dates and (77, "2021-06-01") in dates and (8, "2021-06-01") not in dates and not any(w == 5 for w, _ in dates)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet")}
    untouched = {p for p in before if int(p.parent.name.split("=")[1]) not in hit}
    assert untouched and all(after.get(p) == before[p] for p in untouched) and not (set(before) - untouched) & set(after)


def test_correction_that_empties_a_bucket(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    spans = spark.createDataFrame([(1, 1, dt.date(2020, 1, 6), None, "x"), (2, 2, dt.date(2020, 1, 6), None, "y")], SPANS)
    write_known(build(spans), path, ["who"], "2021-01-01", 64)
    correct(path, spans.filter("who = 2"), spans.filter("who = 1").select("who"), build, ["who"], "2021-02-01", 64)
    left = read_known(spark, path, build(spans).schema).collect()
    assert [(r.who, str(r.known_at)) for r in left] == [(2, "2021-01-01")]
    correct(path, spans, spans.select("who").limit(0), build, ["who"], "2021-03-01", 64)
    assert read_known(spark, path, build(spans).schema).count() == 1


@pytest.mark.parametrize("salaries", [[2.0, float("nan")], [2.0, float("inf")], [1e23, 2.0], [0.1] * 10, [None, 3.0], [None]])
def test_mean_salary(spark, salaries):
    """One denominator: exact where every salary is a plain number, of doubles otherwise."""
    rows = [("m", dt.date(2020, 1, 6), s, 1.0, False) for s in salaries]
    weekly = spark.createDataFrame(rows, "m string, week_start date, pay double, tenure double, leaving boolean")
    got = teams.team_weekly(weekly, ["m"], "pay", "tenure", "leaving").first()
    known = [s for s in salaries if s is not None]
    want = sum(known) / len(known) if known else None
    assert got.headcount == len(salaries)
    assert got.mean_salary is None if want is None else got.mean_salary != got.mean_salary if want != want else got.mean_salary == pytest.approx(want)


def test_inclusions_meet_in_one_grouping_of_any_number_of_columns(spark):
    """More columns than a mask has bits; every other one has a value that the key lacks."""
    wide = spark.range(200).select(*[(F.col("id") + F.lit(i % 2)).alias(f"c{i}") for i in range(keys.BITS + 8)])
    pairs = [("key", "id", "wide", c) for c in wide.columns]
    got = keys._lacking({"key": spark.range(200), "wide": wide}, pairs, "long")
    assert got == {p for p in pairs if int(p[3][1:]) % 2}


def test_few_repeats_are_found_behind_the_slice(spark):
    """One pair of equal rows among many: all slices but one would miss it."""
    df = spark.range(5000).select("id", F.when(F.col("id") == 4999, 0).otherwise(F.col("id")).alias("once"))
    assert keys._repeated(df, [("id",), ("once",), ("id", "once")]) == {1}
    assert keys._repeated(df, [("once",)], 1) == {0}
