"""Row and column cleaning. Each function takes a DataFrame first, for ``df.transform``."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanworks.functions.dates import open_end_to_sentinel, parse_timestamp
from spanworks.functions.text import clean_text


def lower_case_names(df: DataFrame) -> DataFrame:
    """All column names in lower case; an error if two names become the same."""
    names = [c.lower() for c in df.columns]
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise ValueError(f"column names differ only in case: {twice}")
    return df.toDF(*names)


def filter_sources(df: DataFrame, sources: Sequence[str], column: str = "source") -> DataFrame:
    """Rows of the named source systems; a null source is dropped."""
    return df.filter(F.col(column).isin(list(sources)))


def filter_live_primary(
    df: DataFrame, status: str = "status", primary: str = "primary", live: str = "live"
) -> DataFrame:
    """Live primary records; a null status or primary flag is dropped."""
    return df.filter((F.col(status) == live) & F.col(primary))


def timestamp_to_dates(df: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """Date columns from timestamp columns (new name -> timestamp column).

    Default: ``date`` from ``timestamp``. An empty mapping takes every timestamp
    column and names its date ``<column>_date``.
    """
    if columns is None:
        columns = {"date": "timestamp"}
    if not columns:
        kinds = (T.TimestampType, T.TimestampNTZType)
        columns = {
            f"{f.name}_date": f.name for f in df.schema.fields if isinstance(f.dataType, kinds)
        }
    return df.withColumns({new: F.to_date(F.col(old)) for new, old in columns.items()})


def with_clean_end_dates(df: DataFrame, end: str = "end_date") -> DataFrame:
    """Adds ``clean_end_date``: the end as a date, 9999-12-31 for open spans."""
    return df.withColumn("clean_end_date", open_end_to_sentinel(F.col(end)))


def clean_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """White space normalised and blanks made null, in the given or in all string columns."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: clean_text(F.col(c)) for c in columns})


def parse_dates(df: DataFrame, column: str, formats: Sequence[str], out: str) -> DataFrame:
    """Adds the parsed timestamp ``out`` and the flag ``<out>_failed`` for texts no format fits."""
    parsed = df.withColumn(out, parse_timestamp(F.col(column), formats))
    failed = F.col(column).isNotNull() & F.col(out).isNull()
    return parsed.withColumn(f"{out}_failed", failed)


def optout_filter(
    df: DataFrame, opted_out: DataFrame, keys: Sequence[str],
) -> DataFrame:
    """Rows whose key is not on the opt-out list."""
    return df.join(opted_out.select(*keys), list(keys), "left_anti")
