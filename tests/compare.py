"""Compare a Spark result with a DuckDB result as multisets of rows, columns by name."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{directory}/{name}.parquet')")
    return con


def plain(value):
    """A value as something hashable that is equal in both engines."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str:
    """Empty if both agree, else what differs."""
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"columns: {sorted(df.columns)} against {sorted(names)}"
    kinds = {c[0]: str(c[1]) for c in cursor.description}
    theirs = rows_of(names, cursor.fetchall())
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if ours == theirs:
        return ""
    extra, lacking = ours - theirs, theirs - ours
    return (
        f"{sum(ours.values())} rows against {sum(theirs.values())}; columns {sorted(names)}; {kinds}; "
        f"only ours {list(extra.items())[:3]}; only theirs {list(lacking.items())[:3]}"
    )
