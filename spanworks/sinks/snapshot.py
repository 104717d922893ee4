"""Snapshots of a DataFrame before and after a transformation.

A decorated function may be a transform (``df -> df``) or a factory that returns
one; both are accepted, so ``df.transform(step())`` and ``df.transform(step)`` save
alike. The row count of a snapshot is observed while it is written, so a save is
one job. ``reuse="reread"`` continues from the files just written instead of
computing the step again in every later save (parquet and ORC keep all types).
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanworks.sources.tables import local_rows

LOG_SCHEMA = "function string, phase string, ts timestamp, path string, row_count long"
_WHEN = ("before", "after", "both")
_REUSE = ("none", "reread")
_MODES = ("overwrite", "append", "ignore", "error", "errorifexists")
# Text formats: full precision of time; in CSV a quote inside a field is doubled and a null
# is written as \N, so that it is not read back as an empty text.
_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
FORMAT_OPTIONS = {
    "csv": {"header": "true", "escape": '"', "nullValue": "\\N", **_TIMES},
    "json": _TIMES,
}
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


@dataclass(frozen=True)
class SnapshotConfig:
    """Shared settings. ``coalesce_partitions`` also narrows the stage that computes
    the rows, so the default leaves the number of files to Spark; ``partitions``
    spreads the rows over that many files instead."""

    save_path: str
    save_format: str = "parquet"
    save_mode: str = "overwrite"
    when: str = "after"
    include_timestamp: bool = True
    coalesce_partitions: int | None = None
    partitions: int | None = None
    reuse: str = "none"
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for name, allowed in (("when", _WHEN), ("reuse", _REUSE), ("save_mode", _MODES)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")
        if self.reuse == "reread" and self.save_format.lower() not in ("parquet", "orc"):
            raise ValueError("reuse='reread' needs a format that keeps all types: parquet or orc")
        if self.reuse == "reread" and self.save_mode != "overwrite" and not self.include_timestamp:
            raise ValueError("reuse='reread' needs a path of its own: overwrite, or a time stamp")

    def get_decorator(self, when: str | None = None) -> Callable:
        """A decorator with these settings."""
        settings = {**self.__dict__, "when": when or self.when}
        return SnapshotSaver(SnapshotConfig(**settings)).save_transform()


def save_dataframe(
    save_path: str, save_format: str = "csv", save_mode: str = "overwrite", when: str = "after",
    include_timestamp: bool = True, coalesce_partitions: int | None = None, **save_options: str,
) -> Callable:
    """Decorator that saves the input and/or result of a transformation."""
    config = SnapshotConfig(
        save_path, save_format, save_mode, when, include_timestamp, coalesce_partitions,
        options=save_options,
    )
    return SnapshotSaver(config).save_transform()


def _flat_for_text(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, which is all a CSV file can hold."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, _NESTED)]
    return df.withColumns({c: F.to_json(F.col(f"`{c}`")) for c in nested})


class SnapshotSaver:
    """Saves snapshots and keeps a log of them."""

    def __init__(self, config: SnapshotConfig | str):
        self.config = SnapshotConfig(config) if isinstance(config, str) else config
        self.saves_log: list[tuple] = []

    def save_transform(self, **overrides) -> Callable:
        """Decorator for one step; ``overrides`` replace settings of the saver."""
        config = SnapshotConfig(**{**self.config.__dict__, **overrides})

        def decorator(func: Callable) -> Callable:
            @functools.wraps(func)
            def wrapper(*args, **kwargs):
                if args and isinstance(args[0], DataFrame):
                    step = lambda df: func(df, *args[1:], **kwargs)
                    return self._run(args[0], step, func.__name__, config)
                made = func(*args, **kwargs)
                if not callable(made):
                    raise TypeError(f"{func.__name__} got no DataFrame and returned no transform")
                return lambda df: self._run(df, made, func.__name__, config)

            return wrapper

        return decorator

    def _run(self, df: DataFrame, step: Callable, name: str, config: SnapshotConfig) -> DataFrame:
        stamp = datetime.now(timezone.utc)
        if config.when in ("before", "both"):
            df = self.save(df, name, "before", config, stamp)
        result = step(df)
        if config.when in ("after", "both"):
            result = self.save(result, name, "after", config, stamp)
        return result

    def save(
        self, df: DataFrame, name: str, phase: str, config: SnapshotConfig, stamp: datetime
    ) -> DataFrame:
        """Write one snapshot, log it, and return the DataFrame to continue with."""
        parts = [name]
        if config.include_timestamp:
            parts += [stamp.strftime("%Y%m%d_%H%M%S"), uuid.uuid4().hex[:8]]
        if config.when == "both" or phase == "before":
            parts.append(phase)
        path = f"{config.save_path.rstrip('/')}/{name}/{'_'.join(parts)}"
        kind = config.save_format.lower()
        out = _flat_for_text(df) if kind == "csv" else df
        if config.partitions:
            out = out.repartition(config.partitions)
        elif config.coalesce_partitions:
            out = out.coalesce(config.coalesce_partitions)
        seen = Observation()
        writer = out.observe(seen, F.count(F.lit(1)).alias("row_count")).write.mode(config.save_mode)
        options = {**FORMAT_OPTIONS.get(kind, {}), **config.options}
        skipped = config.save_mode == "ignore" and _exists(df.sparkSession, path)
        writer.format(kind).options(**options).save(path)
        rows = None if skipped else seen.get.get("row_count", 0)
        self.saves_log.append((name, phase, datetime.now(timezone.utc), path, rows))
        if config.reuse == "reread":
            return df.sparkSession.read.schema(df.schema).format(kind).load(path)
        return df

    def get_saves_summary(self, spark: SparkSession) -> DataFrame:
        """The log: one row per save."""
        return local_rows(spark, self.saves_log, LOG_SCHEMA)

    def append_log(self, spark: SparkSession, path: str) -> None:
        """Add the log to a table shared by many runs."""
        self.get_saves_summary(spark).write.mode("append").parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a snapshot is already there (a write in mode ``ignore`` would do nothing)."""
    try:
        return not spark.read.format("binaryFile").load(path).select("path").isEmpty()
    except AnalysisException:
        return False


def summarize_log(log: DataFrame) -> DataFrame:
    """Per function: number of saves, time and row count of the last one."""
    return log.groupBy("function").agg(
        F.count(F.lit(1)).alias("saves"),
        F.max("ts").alias("last_ts"),
        F.max_by("row_count", F.struct("ts", "phase", "path")).alias("last_row_count"),
    )


def read_snapshot(spark: SparkSession, path: str, save_format: str, schema: T.StructType) -> DataFrame:
    """A snapshot with its own types.

    CSV holds nested columns as JSON text, and may hold line breaks within a field;
    such a file is read by one task, so keep large snapshots in another format.
    """
    kind = save_format.lower()
    if kind != "csv":
        return spark.read.schema(schema).options(**FORMAT_OPTIONS.get(kind, {})).format(kind).load(path)
    flat = T.StructType(
        [
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, _NESTED) else f.dataType)
            for f in schema.fields
        ]
    )
    df = spark.read.schema(flat).options(**FORMAT_OPTIONS["csv"]).option("multiLine", "true").csv(path)
    nested = {
        f.name: F.from_json(F.col(f"`{f.name}`"), f.dataType)
        for f in schema.fields
        if isinstance(f.dataType, _NESTED)
    }
    return df.withColumns(nested) if nested else df
