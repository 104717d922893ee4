"""Column profiles that merge: the state of each part of a table is kept, and a new part reads only itself.

A state holds, per column, exact counts of rows, nulls and blanks, the least and the largest value as
text and as number, and three sketches: of distinct values, of the ranks of numbers, and of frequent
values. States of any grouping of the rows merge into that of all rows, whatever their order. Bounds
against the one-pass profile: distinct counts within 5 % (three deviations), the rank of a quantile
within 1 % of the rows, the count of a frequent value within ``n_rows / KEPT`` of the true one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sizes of the sketches: ranks (k), distinct values (log2 of the registers), frequent values tracked.
RANKS, DISTINCT, KEPT = 400, 13, 1024
QUANTILES = (0.25, 0.5, 0.75)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def states(df: DataFrame, part: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One state per value of ``part`` and column, to be stored beside the rows; nested columns have none.

    One pass that combines before its shuffle, so a part may hold any share of the rows.
    """
    fields = [f for f in df.schema if not isinstance(f.dataType, _NESTED) and (columns is None or f.name in columns)]
    cells = F.array(*[
        F.struct(
            F.lit(f.name).alias("column_name"), F.col(f"`{f.name}`").cast("string").alias("text"),
            (F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")).alias("number"))
        for f in fields])
    rows = df.select((part if part is not None else F.lit("")).alias("part"), F.explode(cells).alias("c")).select("part", "c.*")
    return rows.groupBy("part", "column_name").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("text").isNull()).alias("nulls"),
        F.count_if(F.trim("text") == "").alias("blanks"), F.min("text").alias("least_text"), F.max("text").alias("largest_text"),
        F.min("number").alias("least"), F.max("number").alias("largest"),
        F.hll_sketch_agg("text", DISTINCT).alias("distinct"), F.kll_sketch_agg_double("number", RANKS).alias("ranks"),
        F.expr(f"approx_top_k_accumulate(text, {KEPT})").alias("frequent"))


def merged(stored: DataFrame, top: int = 3) -> DataFrame:
    """The profile of all rows whose states are given: one row per column.

    Columns: column_name, n_rows, nulls, blanks, least_text, largest_text, least, largest, n_distinct
    (estimate), q25, q50, q75 (null for texts), and frequent: up to ``top`` values with their counts,
    the most frequent first, equal counts by value.
    """
    both = stored.groupBy("column_name").agg(
        *[F.sum(c).alias(c) for c in ("n_rows", "nulls", "blanks")], F.min("least_text").alias("least_text"), F.max("largest_text").alias("largest_text"),
        F.min("least").alias("least"), F.max("largest").alias("largest"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"), F.kll_merge_agg_double("ranks").alias("ranks"),
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(frequent, {KEPT}), {KEPT // 2})").alias("seen"))
    real = F.filter("seen", lambda x: x["item"].isNotNull())
    ordered = F.array_sort(F.transform(real, lambda x: F.struct((-x["count"]).alias("minus"), x["item"].alias("item"))))
    shown = F.transform(F.slice(ordered, 1, top), lambda x: F.struct(x["item"].alias("value"), (-x["minus"]).alias("n")))
    some = F.kll_sketch_get_n_double("ranks") > 0
    return both.select(
        "column_name", "n_rows", "nulls", "blanks", "least_text", "largest_text", "least", "largest", "n_distinct",
        *[F.when(some, F.kll_sketch_get_quantile_double("ranks", F.lit(q))).alias(f"q{int(100 * q)}") for q in QUANTILES],
        shown.alias("frequent"))
