"""Data quality figures, one aggregation pass each, returned as one row per column or rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanworks.operators.ordered import previous_value, running


def _as_rows(
    totals: DataFrame, label: str, names: Sequence[str], fields: Sequence[str],
    constants: Mapping[str, Sequence[str | None]] | None = None,
) -> DataFrame:
    """One wide row of ``<field>|<position>`` columns to one row per name."""
    constants = constants or {}
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias(label),
                *[F.lit(values[i]).cast("string").alias(c) for c, values in constants.items()],
                *[F.col(f"`{f}|{i}`").alias(f) for f in fields],
            )
            for i, name in enumerate(names)
        ]
    )
    return totals.select("n_rows", F.inline(rows))


def nullity_stats(df: DataFrame) -> DataFrame:
    """Nulls per column, with the share of all rows."""
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls|{i}") for i, c in enumerate(df.columns)],
    )
    rows = _as_rows(totals, "column_name", df.columns, ["nulls"])
    share = F.try_divide(F.col("nulls"), F.col("n_rows"))
    return rows.select("column_name", "n_rows", "nulls", F.round(share, 6).alias("null_share"))


def quality_profile(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """Nulls, blank texts, distinct values, smallest and largest value per column.

    ``n_distinct`` is a sketch by default: one pass whatever the number of
    columns. ``exact_distinct`` counts exactly, on (column, value) pairs. The
    minimum and maximum are taken on the typed values and shown as text.
    """
    measures = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        blank = F.trim(c) == "" if isinstance(f.dataType, T.StringType) else F.lit(False)
        value = F.to_json(c) if isinstance(f.dataType, T.MapType) else c
        measures += [
            F.count_if(c.isNull()).alias(f"nulls|{i}"),
            F.count_if(blank).alias(f"blanks|{i}"),
            F.min(value).cast("string").alias(f"min_value|{i}"),
            F.max(value).cast("string").alias(f"max_value|{i}"),
        ]
        if not exact_distinct:
            measures.append(F.approx_count_distinct(value).alias(f"n_distinct|{i}"))
    fields = ["nulls", "blanks", "min_value", "max_value"]
    columns = ["column_name", "n_rows", "nulls", "blanks", "n_distinct", "min_value", "max_value"]
    totals = df.agg(*measures)
    if not exact_distinct:
        return _as_rows(totals, "column_name", df.columns, [*fields, "n_distinct"]).select(columns)
    rows = _as_rows(totals, "column_name", df.columns, fields)
    distinct = distinct_counts(df).drop("n_rows")
    return rows.join(distinct, "column_name", "left").fillna(0, ["n_distinct"]).select(columns)


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows and exact number of distinct non-null values per column.

    One aggregate per column, on its own type and reading that column alone; values combine
    map-side, so a frequent value sends one row per map task. An empty table gives zeros.
    """
    def counted(name: str) -> DataFrame:
        value = F.col(f"`{name}`")
        if isinstance(df.schema[name].dataType, T.MapType):
            value = F.to_json(value)
        return df.select(value.alias("v")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("v").alias("n_distinct")).select(
            F.lit(name).alias("column_name"), "n_rows", "n_distinct")

    return reduce(DataFrame.unionAll, [counted(c) for c in columns or df.columns])


def uniqueness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether each column could be a key: as many distinct values as rows."""
    return distinct_counts(df, columns).withColumn(
        "is_unique", F.col("n_distinct") == F.col("n_rows")
    )


def quick_view(df: DataFrame, order: Sequence[str], rows: int = 5) -> DataFrame:
    """A first look: some rows as JSON in a stable order, with the size of the table.

    An empty table gives one row without JSON, so that its size is told too. Only ``rows`` rows
    of each task take part in the sort; the count reads no column and is part of the plan.
    """
    size = df.agg(F.count(F.lit(1)).alias("n_rows"))
    n_columns = F.lit(len(df.columns)).alias("n_columns")
    first = df.orderBy(*order).limit(rows).select(F.to_json(F.struct(*df.columns)).alias("row"), size.scalar().alias("n_rows"), n_columns)
    return first.unionAll(size.filter("n_rows = 0").select(F.lit(None).cast("string").alias("row"), "n_rows", n_columns))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def type_validation(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Declared against actual type per expected column, and values that do not come back unchanged."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    measures = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(expected.fields):
        if actual.get(f.name) in (None, f.dataType):
            broken = F.lit(False)
        else:
            c = F.col(f"`{f.name}`")
            back = c.try_cast(f.dataType).try_cast(actual[f.name])
            broken = c.isNotNull() & ~c.eqNullSafe(back)
        measures.append(F.count_if(broken).alias(f"cast_failures|{i}"))
    names = [f.name for f in expected.fields]
    types = {
        "expected": [f.dataType.simpleString() for f in expected.fields],
        "actual": [actual[n].simpleString() if n in actual else None for n in names],
    }
    rows = _as_rows(df.agg(*measures), "column_name", names, ["cast_failures"], types)
    ok = F.col("expected").eqNullSafe(F.col("actual"))
    return rows.select("column_name", "expected", "actual", ok.alias("ok"), "cast_failures")


def rule_checks(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Rows that break each rule (a SQL predicate), and rows where it is undecided (null)."""
    measures = [F.count(F.lit(1)).alias("n_rows")]
    for i, predicate in enumerate(rules.values()):
        holds = F.expr(predicate)
        measures += [
            F.count_if(~holds).alias(f"violations|{i}"),
            F.count_if(holds.isNull()).alias(f"undecided|{i}"),
        ]
    rows = _as_rows(df.agg(*measures), "rule", list(rules), ["violations", "undecided"])
    return rows.select("rule", "n_rows", "violations", "undecided")


def span_rules(
    df: DataFrame, entity: Sequence[str], start: str, end: str, tie: str, allowed_gap: int = 0, pieces: int | None = None,
) -> DataFrame:
    """Rules across the rows of an entity, with a witness: (entity, tie, rule, witness, days) per broken rule.

    In the order of ``start`` and ``tie``, a span breaks ``overlap`` if it begins before an earlier
    one ends, ``gap`` if it begins more than ``allowed_gap`` days after all earlier ones have ended,
    and ``order`` if it ends before it begins (then it plays no part in the others). The witness is
    the earlier span that ends last (then the larger tie; open ends are the last), for ``order`` the
    span itself; ``days`` is the overlap (up to the end of the shorter; null if that is open), the
    gap, or how far the end lies before the start. No pairs are made: the latest end so far is a
    running maximum.
    """
    keys = [f"k{i}" for i in range(len(entity))]
    rows = df.select(
        *[F.col(e).alias(k) for e, k in zip(entity, keys)], F.col(tie).alias("tie"),
        F.to_date(start).alias("start"), F.to_date(end).alias("end")).filter("start is not null")
    turned = rows.filter("end < start").select(
        *keys, "tie", F.lit("order").alias("rule"), F.col("tie").alias("witness"), F.datediff("start", "end").alias("days"))
    proper = rows.filter("end is null or end >= start").withColumn(
        "reach", F.struct(F.col("end").isNull().alias("open"), F.col("end"), F.col("tie")))
    order = ["start", "tie"]
    far = previous_value(running(proper, keys, order, "reach", "far", F.max, pieces), keys, order, "far", "before", pieces)
    reach = F.col("before")
    ends = F.least("end", reach["end"])
    overlap = reach["open"] | (F.col("start") < reach["end"])
    days = F.datediff("start", reach["end"])
    broken = far.filter(reach.isNotNull()).select(
        *keys, "tie", F.when(overlap, "overlap").when(days > allowed_gap, "gap").alias("rule"), reach["tie"].alias("witness"),
        F.when(overlap, F.datediff(ends, "start")).otherwise(days).alias("days")).filter("rule is not null")
    return broken.unionByName(turned).select(
        *[F.col(k).alias(e) for k, e in zip(keys, entity)], F.col("tie").alias(tie), "rule", "witness", "days")
