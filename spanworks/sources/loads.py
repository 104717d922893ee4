"""Loading with cleaning: dimensions, facts and hierarchies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanworks.operators.clean import clean_strings, lower_case_names
from spanworks.operators.ordered import latest_per_key
from spanworks.operators.people import null_default_ids


def load_dimension(
    raw: DataFrame, keys: Sequence[str], newest_first: Sequence[Column] = (),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Clean names and strings, and keep one row per key (duplicates would inflate later joins)."""
    df = lower_case_names(raw)
    df = clean_strings(df.select(*columns) if columns else df)
    return latest_per_key(df, keys, newest_first) if newest_first else df


def load_fact(
    raw: DataFrame, dates: Sequence[str], required: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Clean names, strings and dates; rows without a required field are dropped."""
    df = lower_case_names(raw)
    df = df.select(*columns) if columns else df
    df = df.dropna(subset=list(required)) if required else df
    return clean_strings(df).withColumns({d: F.to_date(F.col(d)) for d in dates})


def load_hierarchy(
    raw: DataFrame, entity: str, manager: str, default_ids: Sequence[str] = (),
    renames: Mapping[str, str] | None = None,
) -> DataFrame:
    """Manager relations without placeholder managers and without self-management."""
    df = lower_case_names(raw).withColumnsRenamed(dict(renames or {}))
    if default_ids:
        df = null_default_ids(df, [manager], default_ids)
    own = F.col(manager).cast("string") == F.col(entity).cast("string")
    return df.filter(F.col(manager).isNotNull() & ~F.coalesce(own, F.lit(False)))
