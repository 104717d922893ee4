"""Ordered operators: whatever the pieces, the result is that of one window per key."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanworks.operators.ordered import (
    forward_fill,
    latest_per_key,
    next_value,
    previous_value,
    running,
)
from spanworks.operators import clean, joins, ordered, weeks
from tests.compare import rows_of


@pytest.fixture(scope="module")
def skewed(spark):
    """One key (and the null key) hold most rows; many equal times; half the values are null."""
    rnd = random.Random(7)
    rows = []
    for i in range(4000):
        key = rnd.choices([1, None, 2, 3, 100 + i], [45, 25, 10, 10, 10])[0]
        time = rnd.randrange(60) if rnd.random() < 0.7 else 5
        rows.append((key, time, i, rnd.choice([None, None, f"v{rnd.randrange(9)}"])))
    return spark.createDataFrame(rows, "k int, t int, id int, v string").cache()


def same(a, b):
    return rows_of(a.columns, a.collect()) == rows_of(b.columns, b.collect())


CHECKS = {
    "forward_fill": lambda df, n: forward_fill(df, ["k"], ["t", "id"], {"out": "v"}, n),
    "fill_in_place": lambda df, n: forward_fill(df, ["k"], ["t", "id"], {"v": "v"}, n),
    "next_value": lambda df, n: next_value(df, ["k"], ["t", "id"], "v", "out", n),
    "next_in_place": lambda df, n: next_value(df, ["k"], ["t", "id"], "v", "v", n),
    "previous_value": lambda df, n: previous_value(df, ["k"], ["t", "id"], "v", "out", n),
    "running_max": lambda df, n: running(df, ["k"], ["t", "id"], "v", "out", F.max, n),
}


def plain(name, df):
    w = W.partitionBy("k").orderBy("t", "id")
    so_far = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    value = {
        "forward_fill": F.last("v", ignorenulls=True).over(so_far), "fill_in_place": F.last("v", ignorenulls=True).over(so_far),
        "next_value": F.lead("v").over(w), "next_in_place": F.lead("v").over(w), "previous_value": F.lag("v").over(w),
        "running_max": F.max("v").over(so_far),
    }[name]
    return df.withColumn("v" if "in_place" in name else "out", value)


@pytest.mark.parametrize("name", CHECKS)
@pytest.mark.parametrize("size", [None, 7, 300])
def test_pieces_equal_plain(skewed, name, size):
    assert same(CHECKS[name](skewed, size), plain(name, skewed))


@pytest.mark.parametrize("name", CHECKS)
@pytest.mark.parametrize("kind", ["string", "double", "boolean", "date", "array<int>", "struct<a: int, b: string>", "binary"])
def test_order_of_any_type(spark, name, kind):
    """Nulls first, NaN last, whatever the pieces; also where most rows share one moment."""
    literals = {
        "string": ["'b'", "'c'", "''", "'ä'"], "double": ["1.0D", "2e6D", "3e6D", "double('NaN')", "double('-inf')"], "boolean": ["true", "false"],
        "date": ["date'2020-01-01'", "date'1960-05-05'"], "array<int>": ["array(1, 2)", "array(1)", "array(cast(null as int))"],
        "struct<a: int, b: string>": ["named_struct('a', 1, 'b', 'x')", "named_struct('a', cast(null as int), 'b', 'y')"],
        "binary": ["x'00'", "x'ff'"]}[kind]
    values = f"array(cast(null as {kind}), " + ", ".join(f"cast({x} as {kind})" for x in literals) + ")"
    df = spark.range(90).selectExpr(
        "cast(id % 2 as int) AS k", f"{values}[cast(if(id % 3 = 0, 1, pmod(hash(id), {len(literals) + 1})) as int)] AS t",
        "cast(id as int) AS id", "if(pmod(hash(id, 7), 3) = 0, concat('v', id), null) AS v")
    assert same(CHECKS[name](df, 12), plain(name, df))


def test_fill_after_not_a_number(spark):
    df = spark.createDataFrame([(1, 1.0, 1, "a"), (1, 2e6, 2, "b"), (1, 3e6, 3, None), (1, float("nan"), 4, None)], "k int, t double, id int, v string")
    for pieces in (None, 1, 3):
        got = forward_fill(df, ["k"], ["t", "id"], {"out": "v"}, pieces)
        assert [r.out for r in got.orderBy("id").collect()] == ["a", "b", "b", "b"]


def scans(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_four_chained_fills_read_their_source_once(spark, skewed, tmp_path):
    skewed.write.parquet(f"{tmp_path}/rows")
    source = spark.read.parquet(f"{tmp_path}/rows")
    chained = source
    for k in range(4):
        chained = forward_fill(chained, ["k"], ["t", "id"], {f"out{k}": "v"})
    assert scans(chained) == 1 and chained.count() == 4000
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    chained = source.mapInArrow(counted, source.schema)
    for k in range(4):
        chained = forward_fill(chained, ["k"], ["t", "id"], {f"out{k}": "v"}, pieces=5)
    expected = F.last("v", ignorenulls=True).over(W.partitionBy("k").orderBy("t", "id").rowsBetween(W.unboundedPreceding, W.currentRow))
    assert same(chained, source.withColumns({f"out{k}": expected for k in range(4)}))
    assert read.value == 4000


def test_borders_are_few_and_pieces_even(spark):
    """A key that holds most rows, all at one moment, is cut; keys within a piece send no summary."""
    df = spark.range(20_000).selectExpr("if(id % 10 < 7, 0L, id) AS k", "if(id % 10 < 7, 0L, id % 50) AS t", "id")
    events, window, _ = ordered._with_carry(
        df.withColumn("v", F.col("id")), ["k"], ["t", "id"], 16, {"v": F.max("v")}, lambda n, along: F.max(n).over(ordered._before(along)), -1)
    sizes = {r._piece: r["count"] for r in events.filter("_side = 0").groupBy("_piece").count().collect()}
    assert len(sizes) >= 14 and max(sizes.values()) < 3 * 20_000 / 16
    assert events.filter("_side <> 0").count() <= 16


def test_rows_look_at_the_borders_near_them_alone(spark):
    """However many pieces there are, most rows see no border, as their key shares a slot with none."""
    df = spark.range(20_000).selectExpr("id % 9000 AS k", "id AS t")
    key, pieces = F.struct(F.col("k").alias("k0")), 400
    slot = lambda key: F.pmod(F.xxhash64(key["k0"]), F.lit(ordered.SLOTS * pieces)).cast("int")
    place = F.struct(key.alias("key"), F.struct(F.col("t").alias("o0")).alias("at"))
    slots = ordered._borders(df, place, pieces, slot)
    seen = df.withColumn("near", F.get(slots, slot(key)))
    assert seen.agg(F.avg(F.size("near"))).first()[0] < 0.2 and seen.filter("near IS NULL").isEmpty()
    borders = seen.select(F.explode("near").alias("b")).distinct()
    assert 350 < borders.count() <= pieces
    assert seen.join(borders, (F.col("k") == F.col("b.key.k0")) & (F.col("t") == F.col("b.at.o0"))).filter(
        "array_contains(near, b)").count() == borders.count()


@pytest.mark.parametrize("name", CHECKS)
def test_keys_that_differ_in_bytes_alone(spark, name):
    """Equal by their collation, or zeros of both signs: one key, whatever the pieces."""
    rows = spark.range(400).selectExpr(
        "collate(if(id % 3 = 0, 'A', if(id % 3 = 1, 'a', 'b')), 'UTF8_LCASE') AS k", "cast(id % 40 as int) AS t", "cast(id as int) AS id",
        "if(pmod(hash(id, 7), 3) = 0, concat('v', id), null) AS v")
    zeros = rows.withColumn("k", F.expr("if(id % 3 = 0, 0.0D, if(id % 3 = 1, -0.0D, double('NaN')))"))
    few = zeros.withColumn("k", F.when(F.col("id") % 50 == 0, F.col("k")).otherwise(F.col("id").cast("double")))
    for df in (rows, zeros, few):
        ours, theirs = (x.drop("k") for x in (CHECKS[name](df, 9), plain(name, df)))
        assert same(ours, theirs)


def test_internal_names_do_not_clash(skewed):
    odd = skewed.withColumns({c: F.lit(c) for c in ("_piece", "_side", "_v", "_r", "_f0", "_rn")})
    for name, make in CHECKS.items():
        assert same(make(odd, 6), plain(name, odd)), name
    assert latest_per_key(odd, ["k"], [F.desc("t"), F.desc("id")]).columns == odd.columns


def test_names_of_both_sides_are_refused_or_renamed(skewed_facts, skewed_spans):
    spans = skewed_spans.withColumn("fact", F.col("span") + 1)
    args = ["k"], "t", "s"
    for bad in (lambda: joins.asof_join(skewed_facts, spans, *args, ["fact"], [F.desc("span")]),
                lambda: joins.covariate_at(skewed_facts, spans, *args, "e", ["FACT"], "span"),
                lambda: joins.interval_join(skewed_facts, spans, *args, "e", ["span", "t"], "2021-01-01 00:00:00")):
        with pytest.raises(ValueError, match="both sides have"):
            bad()
    joined = joins.asof_join(skewed_facts, spans, *args, {"other": "fact", "again": "fact"}, [F.desc("span")])
    assert joined.columns == ["k", "fact", "t", "other", "again"] and joined.filter("other <> again").isEmpty()
    pairs = joins.interval_join(skewed_facts.withColumn("_start", F.lit(1)), spans, *args, "e", {"other": "fact"}, "2021-01-01 00:00:00")
    assert pairs.columns == ["k", "fact", "t", "_start", "other"]


def test_fill_keeps_values_and_leading_nulls(skewed):
    filled = forward_fill(skewed, ["k"], ["t", "id"], {"out": "v"}, 9)
    assert filled.filter("v IS NOT NULL AND NOT (out <=> v)").isEmpty()
    seen = F.count("v").over(W.partitionBy("k").orderBy("t", "id"))
    assert filled.withColumn("seen", seen).filter("(seen = 0) <> (out IS NULL)").isEmpty()
    assert filled.count() == skewed.count()


def test_latest_per_key_limits_before_the_shuffle(skewed):
    top = latest_per_key(skewed, ["k"], [F.desc("t"), F.desc("id")])
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert top.count() == skewed.select("k").distinct().count()


@pytest.fixture(scope="module")
def skewed_spans(spark):
    """Overlapping spans, most of one key; some open, some empty."""
    rnd = random.Random(3)
    day = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(600):
        start = day + dt.timedelta(hours=rnd.randrange(3000))
        end = None if rnd.random() < 0.05 else start + dt.timedelta(hours=rnd.randrange(0, 200))
        rows.append((rnd.choices([1, None, 2 + i % 5], [6, 1, 3])[0], i, start, end))
    return spark.createDataFrame(rows, "k int, span int, s timestamp_ntz, e timestamp_ntz").cache()


@pytest.fixture(scope="module")
def skewed_facts(spark):
    rnd = random.Random(4)
    day = dt.datetime(2019, 12, 25)
    rows = [
        (rnd.choices([1, None, 2 + i % 7], [6, 1, 3])[0], i,
         None if i % 97 == 0 else day + dt.timedelta(hours=rnd.randrange(3400)))
        for i in range(900)
    ]
    rows += [(1, 2000, day)] * 3
    return spark.createDataFrame(rows, "k int, fact int, t timestamp_ntz").cache()


def brute_pairs(facts, spans, as_of):
    spans = [tuple(r) for r in spans.collect()]
    out = []
    for k, fact, t in (tuple(r) for r in facts.collect()):
        hits = [
            s for sk, s, a, b in spans
            if k is not None and sk == k and t is not None and a <= t < (b or as_of)
        ]
        out += [(k, fact, t, s) for s in hits] or [(k, fact, t, None)]
    return rows_of(["k", "fact", "t", "span"], out)


@pytest.mark.parametrize("hours", [6, 24 * 28])
def test_interval_join_against_brute_force(skewed_facts, skewed_spans, hours):
    joined = joins.interval_join(
        skewed_facts, skewed_spans, ["k"], "t", "s", "e", ["span"], "2021-01-01 00:00:00",
        bucket_hours=hours,
    )
    expected = brute_pairs(skewed_facts, skewed_spans, dt.datetime(2021, 1, 1))
    assert rows_of(joined.columns, joined.collect()) == expected


def test_interval_join_of_dates_on_timestamps(spark):
    facts = spark.sql("SELECT 1 AS k, DATE '2020-01-01' AS t UNION ALL SELECT 1, DATE '2020-01-02'")
    spans = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '2020-01-01 15:00:00' AS s, TIMESTAMP_NTZ '2020-01-03 00:00:00' AS e, 7 AS span")
    pairs = joins.interval_join(facts, spans, ["k"], "t", "s", "e", ["span"], "2021-01-01")
    assert {r.t.day: r.span for r in pairs.collect()} == {1: None, 2: 7}
    assert same(pairs, joins.covariate_at(facts, spans, ["k"], "t", "s", "e", ["span"], "span"))


@pytest.mark.parametrize("limit", [None, 300, 1])
def test_asof_join_against_brute_force(skewed_facts, skewed_spans, limit):
    """Pieces as the size asks, one, and very many; and a crowded moment."""
    facts = skewed_facts.unionAll(
        skewed_facts.filter("fact = 1").select(
            F.lit(1).alias("k"), F.explode(F.sequence(F.lit(3000), F.lit(3080))).alias("fact"),
            F.lit(dt.datetime(2020, 2, 2)).cast("timestamp_ntz").alias("t"),
        )
    )
    joined = joins.asof_join(
        facts, skewed_spans, ["k"], "t", "s", ["span", "e"], [F.desc("span")], limit
    )
    spans = [tuple(r) for r in skewed_spans.collect()]
    expected = []
    for k, fact, t in (tuple(r) for r in facts.collect()):
        past = [(a, s, b) for sk, s, a, b in spans if k is not None and sk == k and t and a <= t]
        _, s, b = max(past, key=lambda x: (x[0], x[1])) if past else (None, None, None)
        expected.append((k, fact, t, s, b))
    assert rows_of(joined.columns, joined.collect()) == rows_of(["k", "fact", "t", "span", "e"], expected)


def test_covariate_at_large_key_agrees(spark, skewed_facts, skewed_spans):
    flat = next_value(skewed_spans.drop("e"), ["k"], ["s", "span"], "s", "e", None)
    args = (["k"], "t", "s", "e", ["span"], "span")
    plain = joins.covariate_at(skewed_facts, flat, *args)
    large = joins.covariate_at(skewed_facts, flat, *args, pieces=2)
    pairs = joins.interval_join(
        skewed_facts, flat, ["k"], "t", "s", "e", ["span"], "2021-01-01 00:00:00"
    )
    assert same(plain, large) and same(plain, pairs)


def test_week_ranges_of_a_large_entity_agree(skewed_spans):
    flat = next_value(skewed_spans.drop("e"), ["k"], ["s", "span"], "s", "e", None)
    flat = flat.withColumns({"s": F.to_date("s"), "e": F.to_date("e")})
    make = lambda n: weeks.start_stop_from_spans(
        flat, ["k"], "s", "e", "span", "2020-07-01", ["span"], pieces=n
    )
    weekly = weeks.weekly_unique(
        weeks.weekly_episodes(flat, "s", "e", "2020-07-01"), ["k"], "s", "span"
    )
    assert same(make(None), make(30))
    assert same(make(None), weeks.start_stop(weekly, ["k"], ["span"]))


@pytest.mark.parametrize("limit", [None, 40])
def test_weekly_owned_agrees_on_overlapping_spans(skewed_spans, limit):
    dated = skewed_spans.withColumns({"s": F.to_date("s"), "e": F.date_add(F.to_date("e"), F.col("span") % 50)})
    plain = weeks.weekly_unique(
        weeks.weekly_episodes(dated, "s", "e", "2020-07-01"), ["k"], "s", "span"
    )
    owned = weeks.weekly_owned(dated, ["k"], "s", "e", "span", "2020-07-01", limit)
    assert same(plain, owned.select(plain.columns))


def test_overlapping_spans_keep_their_weeks(spark):
    """A, with B inside: A, B, A; and two terminations that touch stay two rows."""
    spans = spark.sql("""SELECT * FROM VALUES (1, 1, DATE '2020-01-06', DATE '2020-03-31', 'A', 'Vol'), (1, 2, DATE '2020-01-20', DATE '2020-01-28', 'B', 'Vol'),
      (2, 3, DATE '2020-01-06', DATE '2020-01-20', 'J', 'Vol'), (2, 4, DATE '2020-01-20', DATE '2020-02-03', 'J', 'Vol'),
      (2, 5, DATE '2020-02-03', DATE '2020-02-10', 'J', null) AS t(k, span, s, e, job, term)""")
    got = weeks.start_stop_from_spans(spans, ["k"], "s", "e", "span", "2021-01-01", ["job"], "term").orderBy("k", "start_date")
    assert [(r.k, str(r.start_date), str(r.end_week_date), r.job) for r in got.collect()] == [
        (1, "2020-01-06", "2020-01-13", "A"), (1, "2020-01-20", "2020-01-27", "B"), (1, "2020-02-03", "2020-03-30", "A"),
        (2, "2020-01-06", "2020-01-13", "J"), (2, "2020-01-20", "2020-01-27", "J"), (2, "2020-02-03", "2020-02-03", "J")]


def test_optout_of_a_large_key(spark, skewed):
    out = clean.optout_filter(skewed, spark.createDataFrame([(1,), (1,), (2,)], "k int"), ["k"])
    assert same(out, skewed.filter("k IS NULL OR k NOT IN (1, 2)"))
