"""Every operator as a query over the test tables, with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanworks.queries import audits, cleaning, discovery, episodes, histories, joining, quality, snapshots

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (episodes, histories, discovery, cleaning, joining, quality, audits, snapshots)


def all_queries() -> dict[str, Query]:
    return {name: run for m in _MODULES for name, (run, _) in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
