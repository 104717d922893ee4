"""The whole run: assignments, people and hierarchy to start-stop rows with team features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.operators.clean import optout_filter
from spanworks.operators.joins import dedup_left_join
from spanworks.operators.people import employment_class, mgr_sup_id, termination_type
from spanworks.operators.teams import team_weekly
from spanworks.operators.weeks import expand_weeks, merge_ranges, week_ranges
from spanworks.sinks.episodes import write_start_stop
from spanworks.sources.loads import load_dimension, load_fact, load_hierarchy
from spanworks.workdir import materialize


@dataclass(frozen=True)
class Inputs:
    """Assignments hold ``pers_id, span_id, start_date, end_date, job_cd, salary, term_cd`` and
    do not overlap per person; people hold ``pers_id, optout``; the hierarchy holds
    ``pers_id, mgr_id, sup_id``."""

    assignments: DataFrame
    people: DataFrame
    hierarchy: DataFrame


@dataclass(frozen=True)
class Settings:
    as_of: str
    termination_rules: Mapping[str, str]
    default_managers: Sequence[str] = ()
    covariates: Sequence[str] = ("salary", "job_cd", "term_type")
    #: Teams outside these sizes have no figures; None: no limit.
    team_size: tuple[int, int | None] = (1, None)
    entity: Sequence[str] = field(default=("pers_id",))
    write_episodes: bool = True


def start_stop_dataset(inputs: Inputs, settings: Settings) -> DataFrame:
    """Start-stop rows with the manager and the team figures of their first week.

    Team figures are null where the manager is unknown or the team size is outside
    the plausible limits. From spans to episodes the rows are shuffled once, on the
    person. Episodes feed both the teams and the result, so they are written once and
    read twice; weeks are listed only inside the team aggregation, which combines
    before its shuffle.
    """
    episodes = _episodes(inputs, settings)
    return _with_teams(episodes, _teams(episodes, settings))


def _with_teams(episodes: DataFrame, weekly: DataFrame) -> DataFrame:
    first_week = weekly.withColumnRenamed("week_start", "start_date")
    return episodes.drop("since_week", "_leaves").join(first_week, ["mgr_sup_id", "start_date"], "left")


def _episodes(inputs: Inputs, settings: Settings) -> DataFrame:
    """Episodes with the manager of the person; written once, as teams and result both read them."""
    entity = list(settings.entity)
    active = optout_filter(inputs.assignments, inputs.people.filter("optout"), entity)
    # an end after as_of is not known yet: the span is open and the event censored
    known = F.when(F.to_date("end_date") <= F.to_date(F.lit(settings.as_of)), F.col("end_date"))
    typed = termination_type(
        active.withColumn("end_date", known), "term_cd", "end_date", settings.termination_rules
    )
    ranges = week_ranges(typed, entity, "start_date", "end_date", "span_id", settings.as_of)
    # a span that others interrupt ends in its termination once, with its last week
    final = F.col("end_week") == F.col("last_week")
    ranges = ranges.withColumn("_leaves", F.when(final & F.col("term_type").isNotNull(), F.col("last_week")))
    kept = [*settings.covariates, "since_week", "_leaves"]
    episodes = merge_ranges(ranges, entity, kept, "term_type", "span_id")
    managers = mgr_sup_id(inputs.hierarchy, "mgr_id", "sup_id", settings.default_managers)
    managers = managers.select(*entity, "mgr_sup_id").filter("mgr_sup_id IS NOT NULL")
    episodes = dedup_left_join(episodes, managers, entity, [F.asc("mgr_sup_id")])
    return materialize(episodes, "episodes") if settings.write_episodes else episodes


def main_run(
    inputs: Inputs, settings: Settings, path: str,
    working_time: Mapping[str, str], permanence: Mapping[str, str], job: str = "job_cd",
) -> tuple[DataFrame, DataFrame]:
    """The whole run, from raw tables to written results: (episodes, weekly teams), read back.

    Loads clean the raw tables, with one row per person and manager relations without
    placeholders and self-management; the job code gives working time and permanence. The
    episodes carry the team figures of their first week; the figures of all weeks are the
    second table. Both are written below ``path``.
    """
    entity = list(settings.entity)
    assignments = load_fact(inputs.assignments, ["start_date", "end_date"], [*entity, "start_date"])
    classed = employment_class(assignments, job, working_time, permanence)
    people = load_dimension(inputs.people, entity, [F.desc("optout")])
    managers = mgr_sup_id(inputs.hierarchy, "mgr_id", "sup_id", settings.default_managers)
    managers = load_hierarchy(managers, entity[0], "mgr_sup_id")
    settings = replace(settings, covariates=[*settings.covariates, "working_time", "permanence"], default_managers=())
    loaded = Inputs(classed, people, managers.select(
        *entity, F.lit(None).cast("string").alias("mgr_id"), F.col("mgr_sup_id").alias("sup_id")))
    spark = inputs.assignments.sparkSession
    episodes = _episodes(loaded, settings)
    weekly = _teams(episodes, settings)
    weekly.write.mode("overwrite").parquet(f"{path}/teams")
    weekly = spark.read.schema(weekly.schema).parquet(f"{path}/teams")
    joined = _with_teams(episodes, weekly)
    write_start_stop(joined, f"{path}/episodes")
    return spark.read.parquet(f"{path}/episodes"), weekly


def _teams(episodes: DataFrame, settings: Settings) -> DataFrame:
    """Weekly figures of teams of plausible size; tenure counts from the person's first span."""
    led = episodes.filter("mgr_sup_id IS NOT NULL").select(
        "mgr_sup_id", "salary", "since_week", F.col("start_date").alias("start_week"),
        F.col("end_week_date").alias("end_week"),
        F.col("_leaves").alias("leaves"),
    )
    weekly = expand_weeks(led).withColumns(
        {
            "tenure_weeks": F.datediff("week_start", "since_week") / 7,
            "leaving": F.col("week_start") == F.col("leaves"),
        }
    )
    team = team_weekly(weekly, ["mgr_sup_id"], "salary", "tenure_weeks", "leaving")
    low, high = settings.team_size
    plausible = F.col("headcount") >= low
    return team.filter(plausible if high is None else plausible & (F.col("headcount") <= high))


def rounded(dataset: DataFrame) -> DataFrame:
    """The spread of salaries to two places; its last digits depend on the order of addition."""
    return dataset.withColumn("sd_salary", F.round("sd_salary", 2))
