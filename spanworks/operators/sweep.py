"""Several span tables at once: sweeps over the days on which something begins or ends.

Within one table the span that starts last (then the larger tie) holds a day, as everywhere in
this package. A table then gives one event per day on which its holder changes. The events of
all tables are brought to one row per entity and day, the state of every table is carried
forward, and only rows on which the state differs from the one before remain. Days are never
listed but where a span outlasts the one that began after it.

Spans are half-open and end at ``as_of`` at the latest; empty ones play no part. Entities with a
null key are an entity of their own. ``pieces`` is that of the ordered operators.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanworks.operators.ordered import forward_fill, next_value, previous_value
from spanworks.operators.weeks import day_ranges


@dataclass(frozen=True)
class Spans:
    """A table of validity spans: ``values`` hold from ``start`` until before ``end`` (null: still)."""

    rows: DataFrame
    start: str
    end: str
    tie: str
    values: Sequence[str]


def _states(tables: Mapping[str, Spans], entity: Sequence[str], as_of: str, pieces: int | None) -> DataFrame:
    """One row per entity and day on which some table changes; a struct per table, null where it holds nothing.

    The struct of the table at place i is ``s{i}`` with the fields ``v0``, ``v1``, ...
    """
    keys = [f"k{i}" for i in range(len(entity))]
    events = []
    for place, table in enumerate(tables.values()):
        spans = table.rows.select(
            *[F.col(e).alias(k) for e, k in zip(entity, keys)], F.col(table.start).alias("start"), F.col(table.end).alias("end"),
            F.col(table.tie).alias("tie"), F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(table.values)]).alias("held"))
        held = day_ranges(spans, keys, "start", "end", "tie", as_of, pieces)
        # on a day that ends one range and begins another, the beginning counts
        both = F.array(
            F.struct(F.col("start_day").alias("day"), F.lit(1).alias("begins"), F.col("held")),
            F.struct(F.date_add("end_day", 1).alias("day"), F.lit(0).alias("begins"), F.lit(None).cast(spans.schema["held"].dataType).alias("held")))
        events.append(held.select(*keys, F.explode(both).alias("e")).select(
            *keys, "e.day", F.struct("e.begins", "e.held").alias(f"e{place}")))
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), events)
    names = [f"e{i}" for i in range(len(events))]
    # at most one beginning and one end a day and table: which of several equal ones does not matter
    days = union.groupBy(*keys, "day").agg(*[F.max_by(n, F.col(n)["begins"]).alias(n) for n in names])
    filled = forward_fill(days, keys, ["day"], {n: n for n in names}, pieces)
    return filled.select(*keys, "day", *[F.col(f"e{i}")["held"].alias(f"s{i}") for i in range(len(events))])


def _runs(states: DataFrame, entity: Sequence[str], value: Column, holds: Column, pieces: int | None) -> DataFrame:
    """(entity, start_date, end_date, value): longest runs of days on which ``value`` is the same and ``holds``."""
    keys = [f"k{i}" for i in range(len(entity))]
    rows = states.select(*keys, "day", F.struct(holds.alias("holds"), value.alias("value")).alias("state"))
    rows = previous_value(rows, keys, ["day"], "state", "before", pieces)
    changes = rows.filter(~F.col("state").eqNullSafe(F.col("before"))).drop("before")
    runs = next_value(changes, keys, ["day"], "day", "end_date", pieces).filter("state.holds")
    return runs.select(*[F.col(k).alias(e) for k, e in zip(keys, entity)], F.col("day").alias("start_date"), "end_date", F.col("state.value").alias("value"))


def episodes_from_many(
    tables: Mapping[str, Spans], entity: Sequence[str], as_of: str, pieces: int | None = None,
) -> DataFrame:
    """Temporal full outer join: the longest periods in which no value of any table changes.

    Columns: entity, ``start_date``, ``end_date`` (exclusive), the values of all tables under
    their names (null where their table holds nothing), and ``valid_in``, the tables that hold
    the period, in the order given. Periods that no table holds are left out.
    """
    names = [v for t in tables.values() for v in t.values]
    taken = [*names, *entity, "start_date", "end_date", "valid_in"]
    if len({n.lower() for n in taken}) < len(taken):
        raise ValueError(f"names that occur twice among {', '.join(taken)}")
    states = _states(tables, entity, as_of, pieces)
    held = [F.col(f"s{i}") for i in range(len(tables))]
    valid = F.filter(F.array(*[F.when(s.isNotNull(), F.lit(n)) for s, n in zip(held, tables)]), lambda n: n.isNotNull())
    values = [
        held[place][f"v{i}"].alias(v) for place, t in enumerate(tables.values()) for i, v in enumerate(t.values)]
    runs = _runs(states, entity, F.struct(*values, valid.alias("valid_in")), F.size(valid) > 0, pieces)
    return runs.select(*entity, "start_date", "end_date", "value.*")


def overlay_sources(
    sources: Mapping[str, Spans], entity: Sequence[str], as_of: str, pieces: int | None = None,
) -> DataFrame:
    """One history out of several systems, the best first: per value that of the best source that has it.

    Every source gives the same values, in the same order, named as in the first one. At each
    moment a value is that of the first source that holds the entity then and whose value is not
    null; ``{value}_source`` says which. Columns: entity, ``start_date``, ``end_date`` (exclusive),
    values and their sources. Periods that no source holds are left out.
    """
    first = next(iter(sources.values()))
    if any(len(s.values) != len(first.values) for s in sources.values()):
        raise ValueError("every source must give the same values")
    states = _states(sources, entity, as_of, pieces)
    held = [F.col(f"s{i}") for i in range(len(sources))]
    values = []
    for i, value in enumerate(first.values):
        given = [s[f"v{i}"] for s in held]
        values += [F.coalesce(*given).alias(value), F.coalesce(
            *[F.when(g.isNotNull(), F.lit(n)) for g, n in zip(given, sources)]).alias(f"{value}_source")]
    holds = reduce(lambda a, b: a | b, [s.isNotNull() for s in held])
    return _runs(states, entity, F.struct(*values), holds, pieces).select(*entity, "start_date", "end_date", "value.*")
