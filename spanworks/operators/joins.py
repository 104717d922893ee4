"""Joins of facts, dimensions and validity spans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from spanworks.operators.ordered import forward_fill, free_name, latest_per_key


def dedup_left_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], newest_first: Sequence[Column],
) -> DataFrame:
    """Left join to one row per key, so that the left row count never changes."""
    return left.join(latest_per_key(right, keys, newest_first), list(keys), "left")


def calc_join(
    fact: DataFrame, dimensions: Sequence[tuple[DataFrame, Sequence[str], Sequence[Column]]],
) -> DataFrame:
    """A fact with several dimensions, each ``(table, keys, newest-first order)``.

    No broadcast of a dimension is forced: Spark does so when its size, as known from
    the files, is below the threshold, and otherwise shuffles.
    """
    for dimension, keys, newest_first in dimensions:
        fact = dedup_left_join(fact, dimension, keys, newest_first)
    return fact


def renamed_values(values: Sequence[str] | Mapping[str, str], taken: Sequence[str]) -> dict[str, str]:
    """Output name to column of the ``values`` of a join; names that the other side has are refused."""
    out = dict(values) if isinstance(values, Mapping) else {v: v for v in values}
    both = sorted({v.lower() for v in out} & {c.lower() for c in taken})
    if both:
        raise ValueError(f"both sides have {', '.join(both)}: give values as a mapping of new names to columns")
    return out


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    values: Sequence[str] | Mapping[str, str], newest_first: Sequence[Column] = (), pieces: int | None = None,
) -> DataFrame:
    """Every left row with the latest right ``values`` at or before its time.

    Both sides go through one union and one fill: one shuffle, no pairs. ``newest_first``
    picks among right rows of the same key and time; leave it empty when (keys, time) is
    unique on the right. Left rows without a key or a time match nothing and take no part in
    the fill. ``values`` may map new names to columns; a name of the left side is refused.
    """
    def known(time: str) -> Column:
        return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, time)])

    named = renamed_values(values, left.columns)
    right = right.filter(known(right_time))
    names = [f"_a{i}" for i in range(len(keys))]
    keyed = [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]
    if newest_first:
        right = latest_per_key(right, [*keys, right_time], newest_first)
    time = wider(left.schema[left_time].dataType, right.schema[right_time].dataType)
    hashed = [f.name for f in left.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    # rows without a place stay on the left side of the union, each under a key of its own that no right row has
    rows = left.select(
        *keyed, F.col(left_time).cast(time).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(1).alias("_late"),
        F.when(~known(left_time), F.xxhash64(F.lit(0), *hashed)).alias("_placeless"))
    records = right.select(
        *keyed, F.col(right_time).cast(time).alias("_t"),
        F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(named.values())]).alias("_r"), F.lit(0).alias("_late"))
    events = records.unionByName(rows, allowMissingColumns=True)
    filled = forward_fill(events, [*names, "_placeless"], ["_t", "_late"], {"_r": "_r"}, pieces).filter("_late = 1")
    return filled.select(
        *[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_r")[f"v{i}"].alias(n) for i, n in enumerate(named)])


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type in which two times are compared: a timestamp if either is one."""
    return b if isinstance(a, T.DateType) else a


def covariate_at(
    facts: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, start: str, end: str,
    values: Sequence[str] | Mapping[str, str], tie: str, pieces: int | None = None,
) -> DataFrame:
    """Span values valid at the time of each fact, for spans of a key that do not overlap.

    Then at most the latest started span can hold the fact, and the interval join
    is an as-of join with a check of the end. Facts outside every span keep nulls. ``values``
    may map new names to columns; a name of the facts is refused.
    """
    named = renamed_values(values, facts.columns)
    lasting = spans.filter(F.col(end).isNull() | (F.col(start) < F.col(end)))
    records = lasting.select(
        *keys, F.col(start).alias("_start"), F.col(tie).alias("_span_tie"),
        F.struct(F.col(end).alias("end"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(named.values())]).alias("_span"),
    )
    held = free_name(facts, "_held")
    joined = asof_join(facts, records, keys, time, "_start", {held: "_span"}, [F.desc("_span_tie")], pieces)
    inside = F.col(held)["end"].isNull() | (F.col(time) < F.col(held)["end"])
    return joined.select(
        *facts.columns, *[F.when(inside, F.col(held)[f"v{i}"]).alias(n) for i, n in enumerate(named)])


def interval_join(
    facts: DataFrame, spans: DataFrame, keys: Sequence[str], time: str, start: str, end: str,
    values: Sequence[str] | Mapping[str, str], as_of: str, how: str = "left", bucket_hours: int = 24 * 28,
) -> DataFrame:
    """Every pair of a fact and a span of its key with ``start <= time < end``.

    Spans may overlap. Each span is listed once per bucket of ``bucket_hours`` it
    touches, and the join is on (keys, bucket): a key with many facts and many spans
    is compared only within a bucket, and Spark splits large buckets at run time. Open
    spans end at ``as_of``. A bound of one type and a time of another are compared as
    timestamps. Where the spans of a key never overlap, ``covariate_at`` needs no buckets.
    ``values`` may map new names to columns; a name of the facts is refused.
    """
    named = renamed_values(values, facts.columns)
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")

    def bucket(moment: Column) -> Column:
        hours = F.timestamp_diff("HOUR", F.to_timestamp_ntz(F.lit("1970-01-01")), moment.cast("timestamp_ntz"))
        return F.floor(hours / bucket_hours).cast("int")

    names = [free_name(facts, f"_span_k{i}") for i in range(len(keys))]
    values_in = {free_name(facts, f"_span_v{i}"): (n, v) for i, (n, v) in enumerate(named.items())}
    first, last, touching, placed_in, moment, limit = (
        free_name(facts, n) for n in ("_start", "_stop", "_bucket", "_fact_bucket", "_at", "_facts"))
    kind = wider(facts.schema[time].dataType, wider(spans.schema[start].dataType, spans.schema[end].dataType))
    stop = F.coalesce(F.col(end).cast(kind), F.lit(as_of).cast(kind))
    lasting = spans.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
        F.col(start).cast(kind).alias(first), stop.alias(last), *[F.col(v).alias(c) for c, (_, v) in values_in.items()],
    ).filter(F.col(first) < F.col(last))
    at = F.col(time).cast(kind)
    # buckets before the first or after the last fact are not listed; null without facts
    limits = facts.agg(F.struct(F.min(at).alias("first"), F.max(at).alias("last"))).scalar()
    lasting = lasting.withColumn(limit, limits)
    lasting = lasting.filter((F.col(last) > F.col(limit)["first"]) & (F.col(first) <= F.col(limit)["last"]))
    touched = F.sequence(
        bucket(F.greatest(F.col(first), F.col(limit)["first"])), bucket(F.least(F.col(last), F.col(limit)["last"])))
    listed = lasting.withColumn(touching, F.explode(touched))
    placed = facts.withColumns({placed_in: bucket(at), moment: at})
    on = F.col(placed_in) == F.col(touching)
    for k, n in zip(keys, names, strict=True):
        on = on & (F.col(k) == F.col(n))
    on = on & (F.col(moment) >= F.col(first)) & (F.col(moment) < F.col(last))
    columns = [*facts.columns, *[F.col(c).alias(n) for c, (n, _) in values_in.items()]]
    return placed.join(listed, on, how).select(columns)


def manager_lookup(
    assignments: DataFrame, hierarchy: DataFrame, entity: str, at: str,
    valid_from: str, valid_to: str, values: Sequence[str] | Mapping[str, str], tie: str, pieces: int | None = None,
) -> DataFrame:
    """Assignments with the manager relation valid at date ``at``; none gives nulls."""
    return covariate_at(
        assignments, hierarchy, [entity], at, valid_from, valid_to, values, tie, pieces
    )

