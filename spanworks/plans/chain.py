"""The cleaning and episode steps as factories, for ``df.transform(step())`` chains."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.operators import clean, people, weeks
from spanworks.operators.ordered import forward_fill

Step = Callable[[DataFrame], DataFrame]


def lower_case_names() -> Step:
    return clean.lower_case_names


def filter_sources(sources: Sequence[str]) -> Step:
    return lambda df: clean.filter_sources(df, sources)


def filter_live_primary() -> Step:
    return clean.filter_live_primary


def timestamp_to_dates() -> Step:
    return clean.timestamp_to_dates


def with_clean_end_dates() -> Step:
    return clean.with_clean_end_dates


def with_clean_terminations(
    entity: Sequence[str], start: str, end: str, term: str, recorded: Sequence[str]
) -> Step:
    return lambda df: people.clean_terminations(df, entity, start, end, term, recorded)


def with_weekly_episodes(
    entity: Sequence[str], start: str, end: str, tie: str, as_of: str
) -> Step:
    """Spans to one row per entity and week."""
    return lambda df: weeks.weekly_owned(df, entity, start, end, tie, as_of)


def with_forward_filled_job_cd(
    entity: Sequence[str], order: Sequence[str] = ("week_start",), column: str = "job_cd",
) -> Step:
    """Fills missing job codes; the weekly rows of an entity are bounded by the calendar: one piece."""
    return lambda df: forward_fill(df, entity, order, {column: column}, pieces=1)


def with_mgr_sup_id(manager: str, supervisor: str, default_ids: Sequence[str] = ()) -> Step:
    return lambda df: people.mgr_sup_id(df, manager, supervisor, default_ids)


def union_datasets(tagged: dict[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Rows of all datasets under their union of columns, each tagged with its name."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tagged.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def run_chain(
    df: DataFrame, steps: Sequence[tuple[str, Step]], saver=None, snapshot_steps: Sequence[str] = ()
) -> DataFrame:
    """Apply named steps in order, saving a snapshot after each step named in ``snapshot_steps``."""
    for name, step in steps:
        if saver is not None and name in snapshot_steps:
            named = lambda d, step=step: step(d)
            named.__name__ = name
            step = saver.save_transform()(named)
        df = df.transform(step)
    return df

