"""Tables by directory or by catalog name, and their metadata."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

COLUMN_SCHEMA = "table_name string, ordinal int, column_name string, data_type string, nullable boolean"
LIST_SCHEMA = (
    "position int, category string, tables array<struct<table_name: string, description: string>>"
)


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def quote(name: str) -> str:
    """A dotted name with every part in backticks."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def qualified_name(name: str, catalog: str | None = None) -> str:
    """``schema.table`` placed in a catalog."""
    return f"{catalog}.{name}" if catalog else name


@dataclass(frozen=True)
class CatalogSource:
    """Tables of a session catalog; ``schema_prefix`` goes before every schema name."""

    spark: SparkSession
    catalog: str | None = None
    schema_prefix: str = ""

    def full_name(self, name: str) -> str:
        return qualified_name(self.schema_prefix + name, self.catalog)

    def open(self, name: str) -> DataFrame:
        return self.spark.table(quote(self.full_name(name)))

    def tables_in(self, schema: str) -> DataFrame | None:
        """``table_name`` of every table in a schema; None when it cannot be listed."""
        try:
            shown = self.spark.sql(f"SHOW TABLES IN {quote(self.full_name(schema))}")
        except AnalysisException as e:
            missing = e.getCondition() == "SCHEMA_NOT_FOUND"
            return local_rows(self.spark, [], "table_name string") if missing else None
        shown = shown.filter(~F.col("isTemporary"))
        return shown.select(F.concat(F.lit(schema + "."), "tableName").alias("table_name"))

    def listing(self, names: Iterable[str]) -> DataFrame:
        """``table_name`` of every table in the schemas of ``names`` that can be listed."""
        schemas = sorted({n.rpartition(".")[0] for n in names} - {""})
        found = [local_rows(self.spark, [], "table_name string")]
        found += [t for t in map(self.tables_in, schemas) if t is not None]
        return reduce(DataFrame.unionAll, found)

    def properties(self, name: str) -> DataFrame:
        """Table properties as one row ``(table_name, properties map)``."""
        shown = self.spark.sql(f"SHOW TBLPROPERTIES {quote(self.full_name(name))}")
        pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
        return shown.agg(pairs.alias("properties")).select(
            F.lit(name).alias("table_name"), "properties"
        )

    def details(self, name: str) -> tuple[dict[str, str], datetime | None, datetime | None]:
        """Properties, creation time and last change time, as far as the catalog knows them."""
        text = self.spark.sql(f"DESCRIBE TABLE EXTENDED {quote(self.full_name(name))} AS JSON").first()[0]
        known = json.loads(text)
        own = known.get("table_properties") or {}
        created = known.get("created_time") or own.get("created_time") or own.get("createtime")
        changed = own.get("last_modified_time") or own.get("last_ddl_time")
        return own, _instant(created), _instant(changed)


def _instant(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00")) if text else None
    except ValueError:
        return None


def register_tables(
    spark: SparkSession, directory: str, schemas: Mapping[str, Sequence[str]], prefix: str,
    location: str, properties: Mapping[str, str] | None = None,
) -> CatalogSource:
    """External catalog tables over parquet files in ``directory``; nothing is copied.

    ``schemas`` maps a schema to its tables. ``prefix`` keeps the new schemas apart
    from existing ones; ``location`` is where the (empty) schemas are placed.
    """
    settings = ", ".join(f"{literal(k)} = {literal(v)}" for k, v in (properties or {}).items())
    clause = f" TBLPROPERTIES ({settings})" if settings else ""
    for schema, names in schemas.items():
        spark.sql(
            f"CREATE SCHEMA IF NOT EXISTS {quote(prefix + schema)} LOCATION {literal(f'{location}/{schema}')}"
        )
        for name in names:
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {quote(f'{prefix}{schema}.{name}')} USING parquet "
                f"LOCATION {literal(f'{directory}/{name}.parquet')}{clause}"
            )
    return CatalogSource(spark, schema_prefix=prefix)


def local_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A few metadata rows as a DataFrame whose size Spark knows, so that joins broadcast it."""
    fields = spark.createDataFrame([], schema).schema
    arrow = to_arrow_schema(fields)
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow), fields)


def column_catalog(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per column of the given tables, from their schemas (no data is read)."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), f.nullable)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return local_rows(spark, rows, COLUMN_SCHEMA)


def table_list(spark: SparkSession, categories: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """A list of tables by category as a DataFrame ``(position, category, tables)``."""
    rows = [
        (i, c, [{"table_name": n, "description": text} for n, text in tables])
        for i, (c, tables) in enumerate(categories.items(), 1)
    ]
    return local_rows(spark, rows, LIST_SCHEMA)


def flatten_table_list(categories: DataFrame) -> DataFrame:
    """A list of tables to one entry per row; ``ordinal`` is the place within the category."""
    entries = categories.select(
        "position", "category", F.posexplode("tables").alias("ordinal", "entry")
    )
    return entries.select(
        "position", "category", (F.col("ordinal") + 1).alias("ordinal"),
        F.col("entry.table_name"), F.col("entry.description"),
    )
