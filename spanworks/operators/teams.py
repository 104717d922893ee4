"""Team features per manager and week."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanworks.workdir import materialize

#: Decimal places of salaries that count; more than any currency has.
SALARY_PLACES = 6


def team_weekly(
    weekly: DataFrame, manager: Sequence[str], salary: str, tenure_weeks: str, leaving: str,
) -> DataFrame:
    """Headcount, leavers, mean and spread of salary, mean tenure per manager and week.

    ``weekly`` has one row per entity and week; ``leaving`` is true in the last
    week of an entity that terminates. Everything combines map-side, so the rows
    per week are never shuffled. The mean is taken of an exact sum to ``SALARY_PLACES``
    places, which does not depend on the order in which partial sums meet; in a week in which
    some salary is no such number (NaN, infinite, beyond 22 places before the point) it is that of
    doubles, so NaN for NaN.
    """
    money = F.col(salary).try_cast(f"decimal(28,{SALARY_PLACES})")
    mean = F.when(
        F.count(money) == F.count(salary), F.try_sum(money).cast("double") / F.nullif(F.count(salary), F.lit(0)))
    mean = F.coalesce(mean, F.avg(F.col(salary).cast("double")))
    return weekly.groupBy(*manager, "week_start").agg(
        F.count(F.lit(1)).alias("headcount"),
        F.count_if(F.col(leaving)).alias("leavers"),
        mean.alias("mean_salary"),
        F.stddev_samp(salary).alias("sd_salary"),
        F.avg(tenure_weeks).alias("mean_tenure_weeks"),
    )


def span_of_control(
    weekly: DataFrame, manager: Sequence[str], entity: str, lowest: int, highest: int,
    one_row_per_week: bool = False,
) -> DataFrame:
    """(manager, week) with a plausible number of distinct reports, both limits included.

    ``one_row_per_week`` says that an entity has one row a week, so that counting
    rows is enough and no row needs to be shuffled for the distinct count.
    """
    reports = F.count(entity) if one_row_per_week else F.countDistinct(entity)
    spans = weekly.groupBy(*manager, "week_start").agg(reports.alias("reports"))
    return spans.filter(F.col("reports").between(lowest, highest))


def keep_valid_managers(
    weekly: DataFrame, valid: DataFrame, manager: Sequence[str],
) -> DataFrame:
    """Weekly rows whose (manager, week) passed ``span_of_control``.

    The passed weeks are written first: once Spark knows how few they are, the weekly rows, many
    to a manager and week, need not be brought together by these.
    """
    passed = materialize(valid.select(*manager, "week_start"), "valid")
    return weekly.join(passed, [*manager, "week_start"], "left_semi")


def team_trailing(
    ranges: DataFrame, weekly: DataFrame, manager: Sequence[str], entity: str, weeks: int = 52,
) -> DataFrame:
    """Figures of the ``weeks`` weeks up to each week of a team.

    ``ranges`` has the weeks each entity is in a team, as ``start_week`` .. ``end_week``; ``weekly``
    is ``team_weekly``. Columns: manager, week_start, heads (distinct entities in the window),
    leavers, mean_headcount and median_headcount over its weeks with members, and turnover
    (leavers per mean headcount).

    Heads are exact without a row per window: an entity is in the window of every week from the first
    week of a range until ``weeks`` - 1 weeks after its last, so ranges prolonged by that and merged
    begin and end once each, and running sums over the weeks of a team, which the calendar bounds,
    count them.
    """
    named = [F.col(m).alias(f"m{i}") for i, m in enumerate(manager)]
    team = [f"m{i}" for i in range(len(manager))]
    days = 7 * weeks
    prolonged = ranges.select(*named, F.col(entity).alias("head"), F.col("start_week").alias("first"), F.date_add("end_week", days).alias("gone"))
    own = W.partitionBy(*team, "head").orderBy("first", "gone")  # an entity has at most one range per calendar week
    reach = F.max("gone").over(own.rowsBetween(W.unboundedPreceding, -1))
    marked = prolonged.withColumn("fresh", (reach.isNull() | (F.col("first") > reach)).cast("int"))
    merged = marked.withColumn("run", F.sum("fresh").over(own.rowsBetween(W.unboundedPreceding, W.currentRow))).groupBy(
        *team, "head", "run").agg(F.min("first").alias("first"), F.max("gone").alias("gone"))
    events = merged.select(*team, F.explode(F.array(
        F.struct(F.col("first").alias("week_start"), F.lit(1).alias("step")), F.struct(F.col("gone").alias("week_start"), F.lit(-1).alias("step")))).alias("e"))
    steps = events.groupBy(*team, "e.week_start").agg(F.sum("e.step").alias("step"))
    present = weekly.select(*named, "week_start", "headcount", "leavers")
    by_week = steps.unionByName(present, allowMissingColumns=True).groupBy(*team, "week_start").agg(
        *[F.sum(c).alias(c) for c in ("step", "headcount", "leavers")])
    along = W.partitionBy(*team).orderBy("week_start")
    window = W.partitionBy(*team).orderBy(F.unix_date("week_start")).rangeBetween(-(days - 7), 0)
    figures = by_week.select(
        *team, "week_start", "headcount",
        F.sum("step").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("long").alias("heads"),
        F.sum("leavers").over(window).alias("leavers"), F.avg("headcount").over(window).alias("mean_headcount"),
        F.sort_array(F.collect_list("headcount").over(window)).alias("counts"),  # at most ``weeks`` numbers
    ).filter("headcount is not null")
    middle = lambda k: F.get("counts", F.floor(k / 2).cast("int"))
    median = (middle(F.size("counts") - 1) + middle(F.size("counts"))) / 2
    return figures.select(
        *[F.col(t).alias(m) for t, m in zip(team, manager)], "week_start", "heads", "leavers", "mean_headcount",
        median.alias("median_headcount"), (F.col("leavers") / F.col("mean_headcount")).alias("turnover"))
