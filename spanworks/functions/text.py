"""Text expressions for cleaning and for report cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(text: Column) -> Column:
    """Runs of white space to one space, no space at the ends, blank to null."""
    collapsed = F.regexp_replace(text, "[ \\t\\n\\f\\r]+", " ")
    return F.nullif(F.trim(collapsed), F.lit(""))


def with_thousands(number: Column) -> Column:
    """``1234567`` as ``1,234,567``; null as ``-``."""
    return F.coalesce(F.format_number(number, 0), F.lit("-"))


def truncate_cell(text: Column, width: int = 40) -> Column:
    """At most ``width`` characters followed by ``...`` when something was cut; null as ``''``."""
    cut = F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))
    ).otherwise(text)
    return F.coalesce(cut, F.lit(""))


def name_part(name: Column, part: str) -> Column:
    """``schema`` (``unknown`` when the name has no dot) or ``table`` of a dotted name."""
    parts = F.split(name, "\\.")
    if part == "table":
        return F.element_at(parts, -1)
    if part == "schema":
        return F.when(F.size(parts) > 1, F.get(parts, F.lit(0))).otherwise(F.lit("unknown"))
    raise ValueError(f"part must be 'schema' or 'table', not {part!r}")


def anchor_link(name: Column, accessible: Column) -> Column:
    """``[a.b_c](#a-b-c)`` for accessible tables, the bare name for others."""
    anchor = F.translate(name, "._", "--")
    link = F.concat(F.lit("["), name, F.lit("](#"), anchor, F.lit(")"))
    return F.when(accessible, link).otherwise(name)


def strip_id(ident: Column) -> Column:
    """An identifier without blanks around it and without leading zeros; blank to null."""
    return F.nullif(F.regexp_replace(F.trim(ident), "^0+(?=.)", ""), F.lit(""))
