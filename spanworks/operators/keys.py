"""Keys and foreign keys that hold in the data: sketches rule out, exact counts confirm.

A set of columns is a key if no two rows agree on it; it is minimal if no part of it is a key.
Sets are tried level by level, and a set that holds a smaller key is never tried. One pass over
the table takes a distinct-count sketch of every set of a level; a set whose estimate is far
below the number of rows cannot be a key, and what is left of a level is confirmed by one grouping. Columns with
nulls or of nested types are in no key.

A column is included in a key column if every value of it occurs there. Theta sketches of both
sides settle most pairs: a value in the sketch of one that is missing in the other although small
enough to be there rules the pair out for certain. The rest is confirmed by an anti join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanworks.sources.tables import local_rows
from spanworks.workdir import materialize

#: Size of the distinct sketches (log2), their relative deviation, how many deviations a set may fall short, sketches in one pass.
REGISTERS, DEVIATION, DEVIATIONS, AT_ONCE = 13, 0.0115, 6, 128
#: Columns in a mask; of the values that a set of columns is tried on, one in so many goes first.
BITS, SLICES = 62, 64
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def _sketched(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> list[int]:
    """About how many distinct values each set of columns has."""
    out: list[int] = []
    for at in range(0, len(sets), AT_ONCE):
        some = sets[at : at + AT_ONCE]
        row = df.agg(*[
            F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[F.col(f"`{c}`") for c in s]), REGISTERS)).alias(f"n{i}")
            for i, s in enumerate(some)]).first()
        out += [row[i] for i in range(len(some))]
    return out


def _repeated(df: DataFrame, sets: Sequence[tuple[str, ...]], slices: int = SLICES) -> set[int]:
    """The places of the sets on which two rows agree, for all sets in one pass; values meet by two 64-bit hashes.

    Rows that agree fall into the same slice of the hashes, so most sets are refuted by one slice of
    them; only those that it does not refute have all their rows brought together.
    """
    out: set[int] = set()
    for at in range(0, len(sets), AT_ONCE):
        cells = F.array(*[
            F.struct(F.lit(at + i).alias("place"), *[F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in s]).alias(f"h{seed}") for seed in (1, 2)])
            for i, s in enumerate(sets[at : at + AT_ONCE])])
        if slices > 1:
            cells = F.filter(cells, lambda c: F.pmod(c["h1"], F.lit(slices)) == 0)
        counted = df.select(F.explode(cells).alias("c")).groupBy("c.place", "c.h1", "c.h2").agg(F.count(F.lit(1)).alias("n"))
        out |= {r.place for r in counted.filter("n > 1").select("place").distinct().collect()}
    if slices > 1:
        left = [i for i in range(len(sets)) if i not in out]
        out |= {left[i] for i in _repeated(df, [sets[i] for i in left], 1)}
    return out


def minimal_keys(df: DataFrame, largest: int = 2) -> DataFrame:
    """(key_columns, size): all minimal keys of at most ``largest`` columns, names joined by ', ' in table order.

    The number of sets grows with the columns, not with the rows. A table of at most one row has
    no key to be found and gives none.
    """
    spark = df.sparkSession
    names = [f.name for f in df.schema if not isinstance(f.dataType, _NESTED)]
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    n_rows = first["n"]
    names = [c for i, c in enumerate(names) if first[f"c{i}"] == n_rows]
    keys: list[tuple[str, ...]] = []
    distinct: dict[str, int] = {}
    for size in range(1, largest + 1) if n_rows > 1 else ():
        sets = [s for s in combinations(names, size) if not any(set(k) <= set(s) for k in keys)]
        if size > 1:  # too few combinations of values for a key
            room = [reduce(lambda a, b: a * b, (distinct[c] * (1 + DEVIATIONS * DEVIATION) for c in s)) for s in sets]
            sets = [s for s, most in zip(sets, room) if most >= n_rows]
        found = dict(zip(sets, _sketched(df, sets)))
        if size == 1:
            distinct = {s[0]: n for s, n in found.items()}
        likely = [s for s in sets if found[s] >= n_rows * (1 - DEVIATIONS * DEVIATION)]
        repeated = _repeated(df, likely)
        keys += [s for k, s in enumerate(likely) if k not in repeated]
    return local_rows(spark, [(", ".join(k), len(k)) for k in keys], "key_columns string, size int")


def _kind(kind: T.DataType) -> str | None:
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "long"
    return "string" if isinstance(kind, T.StringType) else None


def _lacking(tables: Mapping[str, DataFrame], pairs: Sequence[tuple[str, str, str, str]], kind: str) -> set[tuple[str, str, str, str]]:
    """The pairs (key table, key column, table, column) whose column has a value that the key lacks.

    Every value is brought together once, with the columns that have it as bits, for all pairs.
    """
    columns = sorted({p[:2] for p in pairs} | {p[2:] for p in pairs})
    place = {c: divmod(i, BITS) for i, c in enumerate(columns)}
    words = [f"m{w}" for w in range(len(columns) // BITS + 1)]

    def bit(column: tuple[str, str], word: int) -> Column:
        return F.lit(1 << place[column][1] if place[column][0] == word else 0).cast("long")

    cells = [
        tables[t].select(F.explode(F.array(*[
            F.struct(F.col(f"`{c}`").cast(kind).alias("v"), *[bit((t, c), w).alias(m) for w, m in enumerate(words)])
            for at, c in columns if at == t])).alias("c")).select("c.*").filter("v is not null")
        for t in sorted({t for t, _ in columns})]
    held = reduce(DataFrame.unionAll, cells).groupBy("v").agg(*[F.bit_or(m).alias(m) for m in words])
    keys = sorted({p[:2] for p in pairs})
    row = held.agg(*[
        F.bit_or(F.when(F.col(f"m{place[k][0]}").bitwiseAND(F.lit(1 << place[k][1]).cast("long")) == 0, F.col(m))).alias(f"k{i}{m}")
        for i, k in enumerate(keys) for m in words]).first()
    return {
        p for p in pairs
        if (row[f"k{keys.index(p[:2])}m{place[p[2:]][0]}"] or 0) >> place[p[2:]][1] & 1}


def inclusions(spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, str], kinds: Sequence[str] = ("long", "string")) -> DataFrame:
    """(table_name, column_name, key_table, key_column) of all columns whose every value is in the key column.

    ``keys`` names a key column of some tables. Whole numbers are compared with whole numbers, texts
    with texts (``kinds`` picks); nulls are no values, and a column without any is in nothing. A
    column is not compared with itself.
    """
    columns = [
        (t, f.name, kind) for t, df in tables.items() for f in df.schema if (kind := _kind(f.dataType)) in kinds and kind]
    parts = []
    for t, df in tables.items():
        own = [(n, kind) for at, n, kind in columns if at == t]
        if own:
            row = df.agg(*[F.theta_sketch_agg(F.col(f"`{n}`").cast(kind)).alias(f"s{i}") for i, (n, kind) in enumerate(own)])
            parts.append(row.select(F.explode(F.array(*[
                F.struct(F.lit(t).alias("table_name"), F.lit(n).alias("column_name"), F.lit(kind).alias("kind"), F.col(f"s{i}").alias("sketch"))
                for i, (n, kind) in enumerate(own)])).alias("c")).select("c.*"))
    sketches = materialize(reduce(DataFrame.unionAll, parts), "sketches")
    named = local_rows(spark, list(keys.items()), "key_table string, key_column string")
    of_keys = sketches.withColumnsRenamed({"table_name": "key_table", "column_name": "key_column", "sketch": "whole"}).join(
        F.broadcast(named), ["key_table", "key_column"])
    pairs = sketches.join(of_keys, "kind").filter("table_name <> key_table OR column_name <> key_column").filter(
        (F.theta_sketch_estimate("sketch") > 0) & (F.theta_sketch_estimate(F.theta_difference("sketch", "whole")) == 0))
    likely = sorted(tuple(r) for r in pairs.select("key_table", "key_column", "table_name", "column_name", "kind").collect())
    lacking = {kind: _lacking(tables, [p[:4] for p in likely if p[4] == kind], kind) for kind in dict.fromkeys(p[4] for p in likely)}
    found = [(t, c, kt, kc) for kt, kc, t, c, kind in likely if (kt, kc, t, c) not in lacking[kind]]
    return local_rows(spark, found, "table_name string, column_name string, key_table string, key_column string")
