"""Normalisation of employment records: terminations, classes, manager ids.

Code rules are small tables the user supplies, ``code -> meaning``; as a mapping
they become a literal inside the projection, so no join is planned for them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanworks.functions.text import strip_id
from spanworks.operators.ordered import latest_per_key

# The three kinds of termination.
VOLUNTARY, INVOLUNTARY, UNKNOWN = "Vol", "Inv", "Unk"


def _look_up(code: Column, rules: Mapping[str, str]) -> Column:
    if not rules:
        return F.lit(None).cast("string")
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(rules.items())])
    return F.try_element_at(literal, code)


def clean_terminations(
    df: DataFrame, entity: Sequence[str], start: str, end: str, term: str,
    recorded: Sequence[str],
) -> DataFrame:
    """One termination record per entity and span, in a consistent state.

    An end before its start becomes null, a termination type without an end
    becomes null, and of several records of a span the last by ``recorded`` stays.
    """
    valid_end = F.when(F.col(end) >= F.col(start), F.col(end))
    cleaned = df.withColumn(end, valid_end).withColumn(
        term, F.when(F.col(end).isNotNull(), F.col(term))
    )
    return latest_per_key(cleaned, [*entity, start], [F.desc(c) for c in recorded])


def ongoing_start_fix(
    df: DataFrame, start: str, end: str, window_start: str, out: str = "effective_start"
) -> DataFrame:
    """Effective start: ongoing records begin no earlier than the observation window."""
    first = F.to_date(F.lit(window_start))
    begun = F.to_date(F.col(start))
    return df.withColumn(
        out, F.when(F.col(end).isNull(), F.greatest(begun, first)).otherwise(begun)
    )


def employment_class(
    df: DataFrame, code: str, working_time: Mapping[str, str], permanence: Mapping[str, str]
) -> DataFrame:
    """Adds ``working_time`` (full/part time) and ``permanence`` (regular/temporary)."""
    return df.withColumns(
        {
            "working_time": F.coalesce(_look_up(F.col(code), working_time), F.lit("Unknown")),
            "permanence": F.coalesce(_look_up(F.col(code), permanence), F.lit("Unknown")),
        }
    )


def termination_type(
    df: DataFrame, code: str, end: str, rules: Mapping[str, str], out: str = "term_type"
) -> DataFrame:
    """Vol, Inv or Unk where the span has ended with a code; null where there is no termination."""
    kind = F.coalesce(_look_up(F.col(code), rules), F.lit(UNKNOWN))
    ended = F.col(end).isNotNull() & F.col(code).isNotNull()
    return df.withColumn(out, F.when(ended, kind))


def mgr_sup_id(
    df: DataFrame, manager: str, supervisor: str, default_ids: Sequence[str] = (),
    out: str = "mgr_sup_id",
) -> DataFrame:
    """Adds one id: the manager's, else the supervisor's; placeholder ids count as missing."""
    def usable(name: str) -> Column:
        ident = strip_id(F.col(name))
        return F.when(~ident.isin(list(default_ids)), ident) if default_ids else ident

    return df.withColumn(out, F.coalesce(usable(manager), usable(supervisor)))


def null_default_ids(df: DataFrame, columns: Sequence[str], default_ids: Sequence[str]) -> DataFrame:
    """Placeholder ids (such as a default manager) to null."""
    ids = list(default_ids)
    return df.withColumns({c: F.when(~F.col(c).isin(ids), F.col(c)) for c in columns})


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds ``is_missing_<column>`` for optional attributes."""
    return df.withColumns({f"is_missing_{c}": F.col(c).isNull() for c in columns})
