"""Scratch space for written intermediate tables, on storage every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_BASE: dict[str, str] = {}


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only by a local session that has
    no such setting; a cluster session without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(
                "set spark.checkpoint.dir to a folder shared by all executors"
            )
        app = spark.sparkContext.applicationId
        base = _LOCAL_BASE.setdefault(app, "") or tempfile.mkdtemp(prefix="spanworks-")
        _LOCAL_BASE[app] = base
    return f"{base.rstrip('/')}/spanworks/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch space and continue from the written table.

    Cuts the lineage, survives the loss of executors, and fixes values that a
    second evaluation would not repeat (partition numbers).
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Estimates from here on say that Spark does not know.
UNKNOWN_BYTES = 1 << 60


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of the size of ``df``; for a scan that of its files, by the columns read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Plan nodes of a scan, and those that only choose rows and columns of it.
_SCANS = {"LogicalRelation", "HiveTableRelation", "DataSourceV2ScanRelation", "InMemoryRelation", "LocalRelation"}
_BY_ROW = {"Project", "Filter"}


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only reads stored rows, so that reading it twice gives the same and costs two scans."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if not plan.deterministic():
        return False
    while plan.nodeName() in _BY_ROW:
        plan = plan.children().apply(0)
    return plan.nodeName() in _SCANS


def once(df: DataFrame, label: str) -> DataFrame:
    """``df``, written first unless it only scans stored rows: for plans that read it more than once."""
    return df if is_scan(df) else materialize(df, label)
