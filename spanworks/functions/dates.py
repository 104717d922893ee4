"""Date and ISO-week expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the date written in place of an open end.
OPEN_END = "9999-12-31"


def week_start(date: Column) -> Column:
    """Monday of the ISO week."""
    return F.trunc(date, "week")


def iso_week(date: Column) -> Column:
    """Label such as ``2020-W53``; the year is the ISO year, not the calendar year."""
    thursday = F.date_add(F.trunc(date, "week"), 3)
    week = F.lpad(F.weekofyear(date).cast("string"), 2, "0")
    return F.concat(F.lpad(F.year(thursday).cast("string"), 4, "0"), F.lit("-W"), week)


def open_end_to_sentinel(end: Column) -> Column:
    """Open ends as 9999-12-31. For display and comparison only: never expand such a span."""
    return F.coalesce(F.to_date(end), F.to_date(F.lit(OPEN_END)))


def parse_timestamp(text: Column, formats: Sequence[str]) -> Column:
    """First format that fits, else null (never an error)."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def date_prefix(text: Column) -> Column:
    """First ten characters of a longer text, the text itself if shorter, ``-`` if none."""
    cut = F.when(F.length(text) > 10, F.substring(text, 1, 10)).otherwise(F.nullif(text, F.lit("")))
    return F.coalesce(cut, F.lit("-"))
