"""Sink of the final start-stop table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_start_stop(
    episodes: DataFrame, path: str, date: str = "start_date", mode: str = "overwrite"
) -> None:
    """Parquet, one folder per start year.

    Rebalancing lets Spark split a year that holds most rows and join small ones.
    """
    dated = episodes.withColumn("start_year", F.year(F.col(date)))
    dated.hint("rebalance", "start_year").write.mode(mode).partitionBy("start_year").parquet(path)
