import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanworks.functions.dates import iso_week
from spanworks.operators import weeks
from spanworks.operators.ordered import next_value
from spanworks.queries.mapping import AS_OF, order_spans

D = dt.date


def spans(spark, rows):
    return spark.createDataFrame(
        rows, "pers_id long, start_date date, end_date date, salary long, job_cd string, term_type string, span_id int"
    )


GOLDEN = [
    (1, D(2019, 12, 30), D(2021, 8, 16), 50000, "123", None, 1),
    (1, D(2021, 8, 16), D(2022, 12, 12), 55000, "123", None, 2),
    (1, D(2022, 12, 12), D(2022, 12, 26), 55000, "123", "Vol", 3),
]
COVARIATES = ["salary", "job_cd", "term_type"]


def both_ways(df, as_of="2023-01-01"):
    weekly = weeks.weekly_unique(
        weeks.weekly_episodes(df, "start_date", "end_date", as_of), ["pers_id"], "start_date", "span_id"
    )
    direct = weeks.start_stop_from_spans(
        df, ["pers_id"], "start_date", "end_date", "span_id", as_of, COVARIATES
    )
    fields = ["pers_id", "start_week", "end_week", *COVARIATES]
    rows = [
        [tuple(r) for r in out.orderBy("pers_id", "start_date").select(fields).collect()]
        for out in (weeks.start_stop(weekly, ["pers_id"], COVARIATES), direct)
    ]
    assert rows[0] == rows[1]
    return rows[0]


def test_golden_start_stop(spark):
    assert both_ways(spans(spark, GOLDEN)) == [
        (1, "2020-W01", "2021-W32", 50000, "123", None),
        (1, "2021-W33", "2022-W49", 55000, "123", None),
        (1, "2022-W50", "2022-W51", 55000, "123", "Vol"),
    ]


@pytest.mark.parametrize(
    "day, week",
    [
        (D(2020, 12, 31), "2020-W53"), (D(2021, 1, 1), "2020-W53"), (D(2021, 1, 3), "2020-W53"),
        (D(2021, 1, 4), "2021-W01"), (D(2019, 12, 30), "2020-W01"), (D(999, 6, 1), "0999-W22"),
        (None, None),
    ],
)
def test_iso_week(spark, day, week):
    df = spark.createDataFrame([(day,)], "d date")
    assert df.select(iso_week(F.col("d"))).first()[0] == week


def test_edge_spans(spark):
    rows = [
        (1, D(2022, 1, 3), D(2022, 1, 3), 1, "a", None, 1),    # empty
        (2, D(2022, 1, 5), D(2022, 1, 4), 1, "a", None, 2),    # end before start
        (3, D(2023, 1, 1), None, 1, "a", None, 3),             # starts at as_of
        (4, D(2022, 12, 27), None, 1, "a", None, 4),           # open, ends with as_of
        (5, D(2022, 1, 3), D(2022, 1, 5), 1, "a", None, 5),    # two spans in one week
        (5, D(2022, 1, 5), D(2022, 1, 7), 2, "a", None, 6),
        (6, D(2022, 1, 3), D(2022, 1, 10), 1, "a", None, 7),   # gap of one week
        (6, D(2022, 1, 17), D(2022, 1, 24), 1, "a", None, 8),
        (7, D(2022, 1, 3), D(2022, 1, 10), None, None, None, 9),  # null covariates join up
        (7, D(2022, 1, 10), D(2022, 1, 17), None, None, None, 10),
    ]
    assert both_ways(spans(spark, rows)) == [
        (4, "2022-W52", "2022-W52", 1, "a", None),
        (5, "2022-W01", "2022-W01", 2, "a", None),
        (6, "2022-W01", "2022-W01", 1, "a", None),
        (6, "2022-W03", "2022-W03", 1, "a", None),
        (7, "2022-W01", "2022-W02", None, None, None),
    ]


def test_open_end_stops_at_as_of(spark):
    df = spans(spark, [(1, D(2022, 12, 1), None, 1, "a", None, 1)])
    weekly = weeks.weekly_episodes(df, "start_date", "end_date", "2023-01-01")
    assert weekly.count() == 5


def test_properties_on_orders(spark, data_dir):
    frame = order_spans(spark, data_dir)
    weekly = weeks.weekly_unique(
        weeks.weekly_episodes(frame, "start_date", "end_date", AS_OF), ["entity"], "start_date", "span_id"
    ).cache()
    episodes = weeks.start_stop(weekly, ["entity"], ["job_cd"]).cache()
    # start-stop rows expand back to the weekly table
    ranges = episodes.select(
        "entity", "job_cd", F.col("start_date").alias("start_week"), F.col("end_week_date").alias("end_week")
    )
    expanded = weeks.expand_weeks(ranges).select("entity", "job_cd", "week_start")
    original = weekly.select("entity", "job_cd", "week_start")
    assert expanded.exceptAll(original).isEmpty() and original.exceptAll(expanded).isEmpty()
    # and never overlap
    w = W.partitionBy("entity").orderBy("start_date")
    assert episodes.withColumn("before", F.lag("end_week_date").over(w)).filter("before >= start_date").isEmpty()
    # the summary counts every week once
    summary = weeks.survival_summary(episodes.withColumn("term_type", F.lit(None).cast("string")), ["entity"])
    assert summary.agg(F.sum("weeks_at_risk")).first()[0] == weekly.count()
    assert summary.filter("event <> 0").isEmpty()


def test_golden_counts(spark):
    frame = order_spans(spark, "/root/testdata/sf0.01")
    weekly = weeks.weekly_episodes(frame, "start_date", "end_date", AS_OF)
    assert weekly.count() == 509_034
    unique = weeks.weekly_unique(weekly, ["entity"], "start_date", "span_id")
    assert unique.count() == 497_498
    assert weeks.start_stop(unique, ["entity"], ["job_cd"]).count() == 12_135


def brute_force(rows, as_of):
    """Owner of every entity-week, then runs of equal values, in plain Python."""
    owners = {}
    for pers, start, end, *values, span in rows:
        end = min(end or as_of, as_of)
        day = start
        while day < end:
            week = day - dt.timedelta(days=day.weekday())
            owners[pers, week] = max(owners.get((pers, week), (D.min,)), (start, span, tuple(values)))
            day += dt.timedelta(days=1)
    out = []
    for (pers, week), (_, _, values) in sorted(owners.items()):
        last = out[-1] if out else None
        if last and last[0] == pers and last[3] == values and week - last[2] == dt.timedelta(days=7):
            last[2] = week
        else:
            out.append([pers, week, week, values])
    return [(p, a, b, *v) for p, a, b, v in out]


@pytest.mark.parametrize("seed", range(4))
def test_random_spans_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    as_of, rows = D(2021, 3, 1), []
    for span in range(120):
        start = D(2019, 11, 1) + dt.timedelta(days=rnd.randrange(500))
        length = rnd.choice([0, 1, 3, 6, 7, 8, 30, 200, -5])
        end = None if rnd.random() < 0.1 else start + dt.timedelta(days=length)
        term = rnd.choice([None, None, "Vol"])
        rows.append((rnd.randrange(6), start, end, rnd.choice([1, 2]), rnd.choice(["a", "b"]), term, span))
    df = spans(spark, rows)
    fields = ["pers_id", "start_date", "end_week_date", *COVARIATES]
    expected = brute_force(rows, as_of)
    args = (["pers_id"], "start_date", "end_date", "span_id", str(as_of))
    weekly = weeks.weekly_unique(
        weeks.weekly_episodes(df, "start_date", "end_date", str(as_of)), ["pers_id"], "start_date", "span_id"
    )
    for way in (weekly, weeks.weekly_owned(df, *args)):
        got = weeks.start_stop(way, ["pers_id"], COVARIATES).orderBy("pers_id", "start_date")
        assert [tuple(r) for r in got.select(fields).collect()] == expected
    # without overlaps the direct way agrees as well
    flat = next_value(df.drop("end_date"), ["pers_id"], ["start_date", "span_id"], "start_date", "end_date")
    flat_rows = [tuple(r) for r in flat.select(df.columns).collect()]
    direct = weeks.start_stop_from_spans(flat, *args, COVARIATES).orderBy("pers_id", "start_date")
    assert [tuple(r) for r in direct.select(fields).collect()] == brute_force(flat_rows, as_of)


def test_calendar_of_nothing_is_empty(spark):
    assert weeks.calendar(spark.createDataFrame([], "d date"), "d").isEmpty()
