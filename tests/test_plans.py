"""Plans that must hold whatever the size of the data."""

import contextlib
import io
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from spanworks.operators import joins, weeks
from spanworks.operators.ordered import forward_fill
from spanworks.queries import all_queries
from spanworks.queries.mapping import AS_OF, order_events, order_spans


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange (?:hash|range|Single|RoundRobin)", plan_of(df)))


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_pairs_and_no_python(spark, data_dir, name):
    plan = plan_of(all_queries()[name](spark, data_dir))
    for bad in ("BroadcastNestedLoopJoin", "CartesianProduct", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan


@pytest.fixture()
def no_broadcast(spark):
    """Plans as for sides too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rows_cross_few_shuffles_from_events_to_episodes(spark, data_dir):
    """From events to episodes everything is by entity, in as many partitions as were asked for."""
    assert exchanges(all_queries()["start_stop_direct"](spark, data_dir)) == 1


def test_weekly_way_from_spans_has_two_shuffles(spark, data_dir):
    spans = order_events(spark, data_dir).withColumn("end_date", F.date_add("start_date", 60))
    weekly = weeks.weekly_unique(
        weeks.weekly_episodes(spans, "start_date", "end_date", AS_OF), ["entity"], "start_date", "span_id"
    )
    assert exchanges(weeks.start_stop(weekly, ["entity"], ["job_cd"])) == 2


def test_fill_shuffles_the_rows_once(spark, data_dir):
    """One exchange for the rows; with pieces the few summaries combine before theirs."""
    assert exchanges(all_queries()["forward_fill"](spark, data_dir)) == 1
    filled = forward_fill(order_events(spark, data_dir), ["entity"], ["start_date", "span_id"], {"job": "job_cd"}, pieces=9)
    main = re.split(r"\n\s*(?=[+:]?-? ?Subquery)", plan_of(filled))[0]
    assert "partial_max_by" in main and exchanges(filled) >= 3
    summaries = re.findall(r"Exchange hashpartitioning\((.*?)\)", plan_of(filled))
    assert len([x for x in summaries if "_piece" in x]) == 2 and len([x for x in summaries if "_piece" not in x]) == 1


def test_asof_join_shuffles_the_union_once(spark, data_dir, no_broadcast):
    orders = order_events(spark, data_dir)
    right = orders.groupBy("entity", "start_date").agg(F.max("span_id").alias("right_id"))
    joined = joins.asof_join(orders, right, ["entity"], "start_date", "start_date", ["right_id"])
    assert exchanges(joined) == 2 and "Join" not in plan_of(joined)


def test_interval_join_is_an_equi_join(spark, data_dir, no_broadcast):
    plan = plan_of(all_queries()["interval_join"](spark, data_dir))
    assert "SortMergeJoin" in plan
    keys = re.search(r"SortMergeJoin \[(.*?)\], \[(.*?)\], LeftOuter", plan)
    assert keys and keys[1].count(",") == 1 and "_bucket" in keys[1] and "entity" in keys[1]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_a_crowded_bucket_is_split(spark, no_broadcast, how):
    """One key and bucket holds nearly all facts; the join splits it at run time."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    facts = spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 20 > 0, 1).otherwise(F.col("id") % 97).alias("k"), "id",
        F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 3600)").alias("t"),
    )
    spans = spark.range(97).select(
        F.col("id").alias("k"), F.col("id").alias("span"),
        F.expr("timestamp_ntz'2020-01-01 00:10:00'").alias("s"),
        F.expr("timestamp_ntz'2020-01-01 00:20:00' + make_dt_interval(0, 0, id * 0)").alias("e"),
    )
    joined = joins.interval_join(
        facts, spans, ["k"], "t", "s", "e", ["span"], "2021-01-01 00:00:00", how, bucket_hours=1
    )
    rows = joined.count()
    counted = joined.agg(F.count("span"), F.sum("id"))
    counted.collect()
    plan = plan_of(counted)
    for k, v in before.items():
        spark.conf.set(k, v)
    inside = facts.filter("t >= timestamp_ntz'2020-01-01 00:10:00' AND t < timestamp_ntz'2020-01-01 00:20:00'")
    assert rows == (400_000 if how == "left" else inside.count())
    assert "SortMergeJoin(skew=true)" in plan


def test_counts_read_no_column(spark, data_dir):
    assert plan_of(all_queries()["table_row_counts"](spark, data_dir)).count("ReadSchema: struct<>") == 14


def test_filters_and_columns_reach_the_scan(spark, data_dir):
    plan = plan_of(all_queries()["filter_sources"](spark, data_dir))
    assert "In(event_type, [click,view])" in plan and "props" not in plan.split("ReadSchema")[1]
    few = weeks.weekly_episodes(order_spans(spark, data_dir), "start_date", "end_date", AS_OF)
    assert "o_totalprice" not in plan_of(few.select("entity", "week_start"))


def test_weekly_rows_are_combined_before_the_shuffle(spark, data_dir):
    plan = plan_of(all_queries()["team_weekly"](spark, data_dir))
    assert re.search(r"Exchange hashpartitioning\(manager#\d+, week_start#\d+.*\n.*HashAggregate.*partial_count", plan)


def test_sources_follow_the_rules():
    root = pathlib.Path(__file__).parent.parent / "spanworks"
    text = "".join(p.read_text() for p in root.rglob("*.py") if "llm" not in p.parts)
    for word in ("localCheckpoint", "crossJoin", ".rdd", "toPandas", ".sample(", "udf("):
        assert word not in text
