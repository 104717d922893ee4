"""Audit of a list of tables: presence, access, size, samples, and the roll-ups.

Opening a table and reading its schema is metadata work and is tried table by
table, so that one failure stays with its table. Row counts of all tables run as
one job that reads no column. Sizes here are those of the table list, never of the
tables.
"""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanworks.functions.text import name_part
from spanworks.operators.classify import with_error_class
from spanworks.sources.tables import CatalogSource, flatten_table_list, local_rows, table_list

_PROBE = (
    "table_name string, opened boolean, error string, columns array<string>, "
    "properties map<string,string>, created_at timestamp, updated_at timestamp, "
    "sample array<string>, probe_seconds double"
)
#: What reading a table may raise: Spark does not convert the failure of a task.
_FAILURES = (PySparkException, Py4JJavaError)
#: Longest text of a cell in a sampled row.
SAMPLE_CHARS = 200
_NOT_LISTED = "TABLE_OR_VIEW_NOT_FOUND: not in the catalog listing"


def distinct_tables(entries: DataFrame) -> DataFrame:
    """One row per table name; the description of the last entry wins."""
    return entries.groupBy("table_name").agg(
        F.max_by("description", F.struct("position", "ordinal")).alias("description")
    )


def catalog_presence(entries: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries with ``in_catalog``; names are compared without regard to case."""
    known = listing.select(F.lower("table_name").alias("_listed")).distinct()
    return entries.join(known, F.lower("table_name") == F.col("_listed"), "left").select(
        *entries.columns, F.col("_listed").isNotNull().alias("in_catalog")
    )


def row_counts(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, row_count)`` of all tables, counted in one job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in tables.items()
    ]
    if not counts:
        return local_rows(spark, [], "table_name string, row_count long")
    return reduce(DataFrame.unionAll, counts)


def _isolated_counts(spark: SparkSession, tables: Mapping[str, DataFrame]):
    """Counts in one job; after a failure table by table, with the error of each."""
    try:
        rows = [(r[0], r[1], None) for r in row_counts(spark, tables).collect()]
    except _FAILURES:
        rows = []
        for name, df in tables.items():
            try:
                rows.append((name, df.count(), None))
            except _FAILURES as e:
                rows.append((name, None, _message(e)))
    return local_rows(spark, rows, "table_name string, row_count long, count_error string")


def _message(e: Exception) -> str:
    if isinstance(e, Py4JJavaError):
        lines = str(e.java_exception.toString()).splitlines()
        return next((line.strip() for line in lines if "[" in line and "]" in line), lines[0])
    condition = e.getCondition() if hasattr(e, "getCondition") else None
    return f"{condition}: {e}" if condition else str(e)


def _cut(df: DataFrame) -> list:
    """The columns, texts and nested values cut to ``SAMPLE_CHARS`` before rows leave the executors."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        plain = isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType))
        out.append((c if plain else F.substring(c.cast("string"), 1, SAMPLE_CHARS)).alias(f.name))
    return out


def _probe(source: CatalogSource, name: str, sample_rows: int, order: Sequence[str] = ()):
    """Metadata row of one table, and the table if it opened."""
    start = time.monotonic()
    try:
        df = source.open(name)
    except _FAILURES as e:
        return (name, False, _message(e), None, None, None, None, None, _since(start)), None
    properties, created, updated, sample = {}, None, None, None
    try:
        properties, created, updated = source.details(name)
    except _FAILURES:
        pass  # the table stays accessible without them
    if sample_rows:
        try:
            # in a stated order the first of each task meet; without one any rows will do
            some = df.orderBy(*order).limit(sample_rows) if order else df
            as_json = some.select(F.to_json(F.struct(*_cut(df))).alias("row"))
            sample = [r["row"] for r in as_json.take(sample_rows)]
        except _FAILURES:
            pass
    row = (name, True, None, df.columns, properties, created, updated, sample, _since(start))
    return row, df


def _since(start: float) -> float:
    return time.monotonic() - start


def audit_tables(
    source: CatalogSource, entries: DataFrame, sample_rows: int = 0, isolate: bool = True,
    sample_order: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One row per distinct table of ``entries``.

    Names missing from the listing of their schema are not probed; names without a
    schema, or of a schema that cannot be listed, are.
    ``sample_rows`` rows are read as JSON per table: the first by the columns that ``sample_order``
    has for its name, any where it has none. The counts run at once, and a
    table whose count fails keeps a null count and its error; ``isolate=False``
    leaves the counts in the returned plan instead, where a failure is one of all.
    """
    spark = source.spark
    names = distinct_tables(entries)
    wanted = sorted(r["table_name"] for r in names.select("table_name").collect())
    listings = {s: source.tables_in(s) for s in {n.rpartition(".")[0] for n in wanted} - {""}}
    listed = {
        schema: {r["table_name"].lower() for r in tables.collect()}
        for schema, tables in listings.items()
        if tables is not None
    }
    rows, opened = [], {}
    for name in wanted:
        schema = name.rpartition(".")[0]
        if schema in listed and name.lower() not in listed[schema]:
            rows.append((name, False, _NOT_LISTED, None, None, None, None, None, 0.0))
            continue
        row, df = _probe(source, name, sample_rows, (sample_order or {}).get(name, ()))
        rows.append(row)
        if df is not None:
            opened[name] = df
    probes = with_error_class(local_rows(spark, rows, _PROBE), "error")
    if isolate:
        counts = _isolated_counts(spark, opened)
    else:
        counts = row_counts(spark, opened).withColumn("count_error", F.lit(None).cast("string"))
    joined = names.join(probes, "table_name").join(counts, "table_name", "left")
    return joined.select(
        "table_name",
        name_part(F.col("table_name"), "schema").alias("schema_name"),
        name_part(F.col("table_name"), "table").alias("short_name"),
        "description",
        F.when(F.col("opened"), F.lit(True)).otherwise(F.col("exists")).alias("exists"),
        F.col("opened").alias("accessible"),
        "error_class",
        F.coalesce("error", "count_error").alias("error"),
        "row_count",
        F.when(F.col("opened"), F.size("columns")).alias("column_count"),
        "columns", "properties", "created_at", "updated_at", "sample",
        "probe_seconds",
        F.lit(datetime.now()).alias("check_time"),
    )


def audit_table(
    source: CatalogSource, name: str, description: str = "", sample_rows: int = 5
) -> DataFrame:
    """The audit of a single table."""
    entries = flatten_table_list(table_list(source.spark, {"": [(name, description)]}))
    return audit_tables(source, entries, sample_rows)


def run_audit(
    source: CatalogSource, categories: Mapping[str, Sequence[tuple[str, str]]], sample_rows: int = 5
) -> tuple[DataFrame, DataFrame]:
    """The audit of a list of tables by category, and its summary per category."""
    entries = flatten_table_list(table_list(source.spark, categories))
    audited = audit_tables(source, entries, sample_rows)
    return audited, by_category(entries, audited)


def accessible(audit: DataFrame) -> DataFrame:
    return audit.filter("accessible")


def blocked(audit: DataFrame) -> DataFrame:
    """Tables that exist but cannot be read."""
    return audit.filter("exists AND NOT accessible")


def missing(audit: DataFrame) -> DataFrame:
    """Tables known not to exist."""
    return audit.filter("NOT exists")


def _tally(grouped) -> DataFrame:
    return grouped.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("accessible").alias("accessible_count"),
        F.count_if("exists").alias("existing_count"),
    )


def _percent(part: str):
    share = F.try_divide(F.col(part) * 100.0, F.col("total"))
    return F.round(share, 1)


def by_category(entries: DataFrame, audit: DataFrame) -> DataFrame:
    """Counts over list entries: a table in two categories counts in both."""
    flags = audit.select("table_name", "accessible", "exists")
    return _tally(entries.join(flags, "table_name").groupBy("category"))


def by_schema(audit: DataFrame) -> DataFrame:
    tally = _tally(audit.groupBy("schema_name")).drop("existing_count")
    return tally.withColumn("accessible_percent", _percent("accessible_count")).orderBy("schema_name")


def overall(audit: DataFrame) -> DataFrame:
    """Totals and percentages; percentages are null for an empty list."""
    totals = audit.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("accessible").alias("accessible_count"),
        F.count_if("exists").alias("existing_count"),
        F.count_if(F.expr("exists AND NOT accessible")).alias("blocked_count"),
        F.count_if(F.expr("NOT exists")).alias("missing_count"),
    )
    return totals.withColumns(
        {
            "accessible_percent": _percent("accessible_count"),
            "existing_percent": _percent("existing_count"),
        }
    )

