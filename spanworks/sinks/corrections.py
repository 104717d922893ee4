"""Corrections to a written start-stop table: only what is affected is built and written again.

The table lies in folders by bucket of the hashed entity. A correction names the entities whose
spans changed; their episodes are built from all their spans as they are now, the other entities
of the same buckets are copied, and the folders of these buckets alone are replaced. Every row
says since when it is known as it stands.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanworks.workdir import materialize

BUCKETS = 64
KNOWN, BUCKET = "known_at", "_bucket"


def _bucket(entity: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*entity), F.lit(buckets)).cast("int")


def _placed(episodes: DataFrame, entity: Sequence[str], buckets: int) -> DataFrame:
    parts = int(episodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return episodes.withColumn(BUCKET, _bucket(entity, buckets)).repartition(parts, BUCKET)


def write_known(episodes: DataFrame, path: str, entity: Sequence[str], known_at: str, buckets: int = BUCKETS) -> None:
    """Writes the whole table anew, all of it known since ``known_at``."""
    known = episodes.withColumn(KNOWN, F.to_date(F.lit(known_at)))
    _placed(known, entity, buckets).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_known(spark: SparkSession, path: str, schema: T.StructType, buckets: Sequence[int] | None = None) -> DataFrame:
    """The table, with ``known_at``; or some of its buckets, whose folders alone are read."""
    fields = [*schema.fields, T.StructField(KNOWN, T.DateType()), T.StructField(BUCKET, T.IntegerType())]
    rows = spark.read.schema(T.StructType(fields)).parquet(path)
    if buckets is not None:
        rows = rows.filter(F.col(BUCKET).isin(*buckets) if buckets else F.lit(False))
    return rows.drop(BUCKET)


def correct(
    path: str, spans: DataFrame, changed: DataFrame, build: Callable[[DataFrame], DataFrame], entity: Sequence[str],
    known_at: str, buckets: int = BUCKETS,
) -> list[int]:
    """Brings the table at ``path`` up to date; returns the buckets whose folders were replaced.

    ``spans`` are all spans as they are now, ``changed`` holds the entities with new, changed or
    removed spans, and ``build`` makes episodes of spans, entity by entity. An entity that has no
    span any more goes. The new folders are computed in full before any is replaced, so a failure
    while computing leaves the table as it was; rows that come out as they were keep their date.
    """
    spark = spans.sparkSession
    hit = materialize(changed.select(*entity).distinct(), "changed")
    same = [F.col(f"_c{i}").eqNullSafe(F.col(e)) for i, e in enumerate(entity)]
    keys = hit.select(*[F.col(e).alias(f"_c{i}") for i, e in enumerate(entity)])
    numbers = sorted(r[0] for r in hit.select(_bucket(entity, buckets)).distinct().collect())  # at most ``buckets``
    episodes = build(spans.join(keys, same, "left_semi"))
    before = read_known(spark, path, episodes.schema, numbers)
    columns = episodes.columns
    dates = before.join(keys, same, "left_semi").withColumnRenamed(KNOWN, "_since")
    renamed = dates.withColumnsRenamed({c: f"_b_{c}" for c in columns})
    alike = [F.col(f"_b_{c}").eqNullSafe(F.col(c)) for c in columns]
    rebuilt = episodes.join(renamed.dropDuplicates([f"_b_{c}" for c in columns]), alike, "left").select(
        *columns, F.coalesce("_since", F.to_date(F.lit(known_at))).alias(KNOWN))
    kept = before.join(keys, same, "left_anti")
    fresh = materialize(kept.unionByName(rebuilt), "corrected")
    empty = sorted(set(numbers) - {r[0] for r in fresh.select(_bucket(entity, buckets)).distinct().collect()})
    _placed(fresh, entity, buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    for number in empty:  # a bucket that lost its last row
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{BUCKET}={number}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return numbers
