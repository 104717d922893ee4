"""Risk sets and cumulative incidence from start-stop rows, without a row per week and entity.

An episode adds one to the number at risk in the week it begins, counted from the first week of
its entity, and takes one off after its last week. These two events are all it sends; they are
combined before the shuffle, and sums over the weeks of a group, which the calendar bounds, give
the number at risk in every week.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Kinds of leaving, as given by ``people.termination_type``.
KINDS = ("Vol", "Inv", "Unk")


def _left(kind: str) -> str:
    return f"left_{kind.lower()}"


def risk_sets(
    episodes: DataFrame, entity: Sequence[str], by: Sequence[str] = (), term_type: str = "term_type",
    kinds: Sequence[str] = KINDS,
) -> DataFrame:
    """(by, week, at_risk, left_..., censored) for every week of tenure in which somebody is at risk.

    ``episodes`` has ``start_date`` and ``end_week_date`` (first days of weeks), not overlapping
    within an entity. Week 0 is the first of the entity; weeks between its episodes are not at
    risk. An entity leaves in its last week if the episode there has a ``term_type``, else it is
    censored there. ``by`` are covariates as of the week. Kinds other than ``kinds`` are no event
    of a kind of their own: they count as censored.
    """
    own = W.partitionBy(*entity)  # an entity has at most one row per calendar week
    last = F.max("end_week_date").over(own)
    weeks = lambda day: (F.datediff(day, F.min("start_date").over(own)) / 7).cast("int")
    placed = episodes.select(
        *by, weeks(F.col("start_date")).alias("begin"), weeks(F.col("end_week_date")).alias("end"),
        F.when(F.col("end_week_date") == last, F.when(F.col(term_type).isin(*kinds), F.col(term_type)).otherwise("")).alias("leaves"))
    none = F.lit(None).cast("string")
    events = F.array(
        F.struct(F.col("begin").alias("week"), F.lit(1).alias("step"), none.alias("leaves")),
        F.struct((F.col("end") + 1).alias("week"), F.lit(-1).alias("step"), none.alias("leaves")),
        F.struct(F.col("end").alias("week"), F.lit(0).alias("step"), F.col("leaves")))
    counted = placed.select(*by, F.explode(events).alias("e")).groupBy(*by, "e.week").agg(
        F.sum("e.step").alias("step"), *[F.count_if(F.col("e.leaves") == k).alias(_left(k)) for k in kinds],
        F.count_if(F.col("e.leaves") == "").alias("censored"))
    along = W.partitionBy(*by).orderBy("week")
    running = counted.withColumns({
        "at_risk": F.sum("step").over(along.rowsBetween(W.unboundedPreceding, W.currentRow)),
        "until": F.coalesce(F.lead("week").over(along) - 1, F.col("week"))}).filter("at_risk > 0")
    listed = running.withColumn("at", F.explode(F.sequence("week", "until")))
    here = F.col("at") == F.col("week")
    return listed.select(
        *by, F.col("at").alias("week"), "at_risk",
        *[F.when(here, F.col(c)).otherwise(0).cast("long").alias(c) for c in [*map(_left, kinds), "censored"]])


def cumulative_incidence(risk: DataFrame, by: Sequence[str] = (), kinds: Sequence[str] = KINDS) -> DataFrame:
    """(by, week, at_risk, survival, incidence_...) from ``risk_sets``.

    ``survival`` is the product-limit estimate after the week; the incidence of a kind adds, week
    by week, the survival before it times the share that leaves in that way, so that the survival
    and all incidences add up to one.
    """
    along = W.partitionBy(*by).orderBy("week")
    so_far = along.rowsBetween(W.unboundedPreceding, W.currentRow)
    gone = sum((F.col(_left(k)) for k in kinds[1:]), F.col(_left(kinds[0])))
    curve = risk.withColumn("survival", F.product(1 - gone / F.col("at_risk")).over(so_far))
    curve = curve.withColumn("before", F.coalesce(F.lag("survival").over(along), F.lit(1.0)))
    return curve.select(
        *by, "week", "at_risk", "survival",
        *[F.sum(F.col("before") * F.col(_left(k)) / F.col("at_risk")).over(so_far).alias(f"incidence_{k.lower()}") for k in kinds])
