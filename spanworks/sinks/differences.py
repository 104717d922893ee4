"""Differences of two snapshots, from digests first and from rows only where these differ.

A keyed snapshot holds its rows in folders by bucket of the hashed key, and beside them the sums of
the rows' digests per leaf, a finer bucket. Sums of leaves are the digests of a bucket, and of the
whole. A comparison goes down this tree: it reads the digests, then the folders of the buckets
that differ, and joins the rows of the leaves that differ. What is equal is never read.

A digest is the pair of sums of two 64-bit hashes of all columns with the number of rows, so that
neither the order of rows nor copies of a row matter; equal digests of different rows have a
chance of 2^-128. Maps are not hashed, and are refused.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from spanworks.operators.ordered import free_name

#: Folders of rows, and leaves within each.
BUCKETS, LEAVES = 64, 256
_HASHES = ("digest", "second")


def _leaf(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS * LEAVES)).cast("int")


def write_keyed(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Writes ``df`` and its digests below ``path``; an existing snapshot there is replaced."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = free_name(df, "_bucket")
    placed = df.withColumn(bucket, F.floor(_leaf(keys) / LEAVES).cast("int")).repartition(parts, bucket)
    placed.write.mode("overwrite").partitionBy(bucket).parquet(f"{path}/rows")
    rows = read_keyed(spark, path, df.schema)
    hashes = {n: F.xxhash64(F.lit(k), *df.columns).cast("decimal(20,0)") for k, n in enumerate(_HASHES)}
    digests = rows.groupBy(_leaf(keys).alias("leaf")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(h).alias(n) for n, h in hashes.items()])
    digests.write.mode("overwrite").parquet(f"{path}/digests")


def read_keyed(spark: SparkSession, path: str, schema: T.StructType, buckets: Sequence[int] | None = None) -> DataFrame:
    """The rows of a snapshot, or those of some buckets, whose folders alone are read."""
    bucket = "_bucket"
    while bucket.lower() in {f.name.lower() for f in schema}:
        bucket = f"_{bucket}"
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(bucket, T.IntegerType())])).parquet(f"{path}/rows")
    if buckets is not None:
        rows = rows.filter(F.col(bucket).isin(*buckets) if buckets else F.lit(False))
    return rows.drop(bucket)


def differing_leaves(spark: SparkSession, before: str, after: str) -> DataFrame:
    """(leaf, bucket) of the leaves whose digests differ; buckets that agree as a whole are passed over."""
    columns = "leaf int, n long, digest decimal(30,0), second decimal(30,0)"
    both = [spark.read.schema(columns).parquet(f"{p}/digests").withColumn("bucket", F.floor(F.col("leaf") / LEAVES).cast("int"))
            for p in (before, after)]
    sums = ["n", *_HASHES]

    def unequal(level: str, tables: list[DataFrame]) -> DataFrame:
        a, b = (t.groupBy(level).agg(F.struct(*[F.sum(s).alias(s) for s in sums]).alias(side)) for t, side in zip(tables, "ab"))
        return a.join(b, level, "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select(level)

    buckets = unequal("bucket", both)
    leaves = unequal("leaf", [t.join(buckets, "bucket", "left_semi") for t in both])
    return leaves.withColumn("bucket", F.floor(F.col("leaf") / LEAVES).cast("int"))


def _shown(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    return F.to_json(column) if isinstance(kind, (T.ArrayType, T.StructType)) else F.col(column).cast("string")


def snapshot_diff(
    spark: SparkSession, before: str, after: str, schema: T.StructType, keys: Sequence[str],
) -> DataFrame:
    """(keys, copy, change, column, before, after) of two keyed snapshots with the columns of ``schema``.

    ``change`` is ``added`` or ``removed``, one row per row of the snapshots with a null column, or
    ``changed``, one row per cell. Rows that share a key are paired in the order of their digests;
    ``copy`` counts them from 1. Null keys are keys. The numbers of the differing buckets, of which
    there are at most ``BUCKETS``, are read while the plan is built, so that it lists the folders to read.
    """
    if clash := [n for n in ("copy", "change", "column", "before", "after") if n in keys]:
        raise ValueError(f"key columns must not be named {', '.join(clash)}")
    leaves = differing_leaves(spark, before, after)
    buckets = sorted(r.bucket for r in leaves.select("bucket").distinct().collect())
    values = [c for c in schema.names if c not in keys]
    sides = []
    for path in (before, after):
        rows = read_keyed(spark, path, schema, buckets)
        own = rows.select(
            *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], _leaf(keys).alias("leaf"),
            F.array(*[_shown(rows, c) for c in values]).cast("array<string>").alias("cells"), F.xxhash64(F.lit(0), *schema.names).alias("digest"))
        own = own.join(F.broadcast(leaves.select("leaf")), "leaf", "left_semi")  # at most BUCKETS * LEAVES numbers
        copies = W.partitionBy(*[f"k{i}" for i in range(len(keys))]).orderBy("digest", "cells")
        sides.append(own.withColumn("copy", F.row_number().over(copies)).drop("leaf"))
    a, b = (s.withColumnsRenamed({c: f"{side}_{c}" for c in s.columns}) for s, side in zip(sides, "ab"))
    on = F.col("a_copy") == F.col("b_copy")
    for i in range(len(keys)):
        on = on & F.col(f"a_k{i}").eqNullSafe(F.col(f"b_k{i}"))
    joined = a.join(b, on, "full").filter(~F.col("a_digest").eqNullSafe(F.col("b_digest")))
    change = F.when(F.col("a_copy").isNull(), "added").when(F.col("b_copy").isNull(), "removed").otherwise("changed")
    nothing = F.lit(None).cast("string")
    cells = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(len(values) - 1)), lambda i: F.struct(
            F.get(F.array(*map(F.lit, values)), i).alias("column"), F.get("a_cells", i).alias("before"), F.get("b_cells", i).alias("after"))),
        lambda c: ~c["before"].eqNullSafe(c["after"])) if values else F.array()
    whole = F.array(F.struct(nothing.alias("column"), nothing.alias("before"), nothing.alias("after")))
    told = F.when(F.col("a_copy").isNotNull() & F.col("b_copy").isNotNull(), cells).otherwise(whole)
    return joined.select(
        *[F.coalesce(f"a_k{i}", f"b_k{i}").alias(k) for i, k in enumerate(keys)],
        F.coalesce("a_copy", "b_copy").alias("copy"), change.alias("change"), F.explode(told).alias("c"),
    ).select(*keys, "copy", "change", "c.*")
