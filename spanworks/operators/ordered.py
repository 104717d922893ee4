"""Ordered per-key operators in which no key goes whole into one task.

What a row receives from the rows before it can be put together from summaries of stretches of
rows. So rows are cut into pieces at borders, places of (keys, order) that are read off a sample of
the rows themselves: a piece holds about ``PIECE_BYTES``, whatever the types of the columns, the
spread of the times or the size of a key. Most keys have no border and stay whole; a row looks
only at the borders that share a slot with its key, so these keys cost the same however many
borders there are. A key that goes on over a border has one summary per piece, combined before its
shuffle; these few rows are carried along the pieces of the key, and reach the rows as one carry
row at the head or the tail of a piece.
The rows themselves cross one shuffle.

An input that is more than a scan is written once before it is cut, so that the sample, the
summaries and the rows come from one evaluation, and chains do not evaluate their source again
and again. An input that fits one piece by Spark's estimate has no borders: one window, one shuffle
and no second look at it.

``order`` must be a total order within the keys, else results (as with any window) depend on
chance. Any type that Spark can order will do: nulls come first, NaN last. Null keys are a key
of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spanworks.workdir import UNKNOWN_BYTES, estimated_bytes, materialize, once

#: Bytes of a piece, by Spark's estimate (that of files for scans).
PIECE_BYTES = 64 << 20
#: The most pieces; sampled rows for each, so that pieces differ little in size; and slots for each, so that few keys share one.
MOST_PIECES, SAMPLED, SLOTS = 10_000, 32, 16


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_first: Sequence[Column]) -> DataFrame:
    """One row per key: the first in ``newest_first`` order.

    Spark plans a limit per group before the shuffle, so a large key sends at
    most one row per map task.
    """
    place = free_name(df, "_rn")
    w = W.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1).drop(place)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores before it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def _cut(df: DataFrame, pieces: int | None) -> tuple[DataFrame, int]:
    """``df`` in a form that may be read several times if it has more than one piece, and how many it has."""
    if pieces == 1 or pieces is None and estimated_bytes(df) <= PIECE_BYTES:
        return df, 1
    known = estimated_bytes(df) < UNKNOWN_BYTES
    df = once(df, "ordered") if known else materialize(df, "ordered")
    return df, pieces or min(MOST_PIECES, 1 + estimated_bytes(df) // PIECE_BYTES)


def _borders(rows: DataFrame, place: Column, pieces: int, slot: Callable[[Column], Column]) -> Column:
    """The first places of all pieces but one, sorted, in an array for each slot: that of their key."""
    sample = rows.select(place.alias("p")).orderBy(F.xxhash64("p"), "p").limit(SAMPLED * pieces)
    ranked = sample.agg(F.sort_array(F.collect_list("p")).alias("s"))
    step = F.greatest(F.lit(1), F.ceil(F.size("s") / F.lit(pieces)).cast("int"))
    ranked = ranked.withColumn("step", step)
    ranked = ranked.select(F.filter("s", lambda p, i: (i + 1) % F.col("step") == 0).alias("b"))
    taken = F.transform("b", lambda p: F.struct(slot(p["key"]).alias("slot"), p.alias("p")))
    empty = F.transform(F.sequence(F.lit(0), F.lit(SLOTS * pieces - 1)), lambda i: F.struct(i.alias("slot"), F.get("b", F.lit(-1)).alias("p")))
    filled = ranked.select(F.inline(F.concat(taken, empty))).groupBy("slot").agg(F.sort_array(F.collect_list("p")).alias("places"))
    slots = F.sort_array(F.collect_list(F.struct("slot", "places")))
    return filled.agg(F.transform(slots, lambda s: s["places"])).scalar()


def _passed(places: Column, pieces: int, reached: Callable[[Column], Column]) -> Column:
    """How many of the sorted ``places``, at most ``pieces``, are ``reached``, which holds up to one of them; found by halving."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(pieces.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(reached(F.get(places, n + s - 1)), n + s).otherwise(n))


def _with_carry(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None,
    summary: Mapping[str, Column], shift: Callable[[str, W], Column], side: int, spread: bool = False,
) -> tuple[DataFrame, W, Callable[[DataFrame], DataFrame]]:
    """Rows and carry rows, the window that reads both, and what leaves the rows alone.

    ``summary`` gives the columns of a piece's summary; ``shift`` turns the summaries of a key,
    in order of its pieces, into what a piece receives from the others. ``spread`` keeps small
    shuffle partitions apart, for rows that are multiplied later on.
    """
    df, pieces = _cut(df, pieces)
    if pieces == 1:
        if spread:
            df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
        return df, W.partitionBy(*keys).orderBy(*order), lambda rows: rows

    piece, carried_side = free_name(df, "_piece"), free_name(df, "_side")
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    place = F.struct(key.alias("key"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("at"))
    # keys that are equal may differ in bytes where their collation says so
    hashed = [f"k{i}" for i, f in enumerate(df.select(*keys).schema) if "collate" not in f.dataType.simpleString()]

    def slot(key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(0), *[key[f] for f in hashed]), F.lit(SLOTS * pieces)).cast("int")

    held = free_name(df, "_places")
    places, near = F.col(held), F.size(held) > 0
    # in most slots there is no border: their keys are whole, and any number will do that is the same for all of a key
    cut = df.withColumn(held, F.get(_borders(df, place, pieces, slot), slot(key))).withColumn(
        piece, F.when(near, _passed(places, pieces, lambda b: b <= place)).otherwise(slot(key)))
    goes_on = _passed(places, pieces, lambda b: b["key"] < key) < _passed(places, pieces, lambda b: b["key"] <= key)
    per_piece = cut.filter(F.when(near, goes_on).otherwise(False)).groupBy(*keys, piece).agg(*[c.alias(n) for n, c in summary.items()])
    cut = cut.drop(held)
    along = W.partitionBy(*keys).orderBy(piece)
    carried = per_piece.withColumns({n: shift(n, along) for n in summary})
    received = [F.col(n).isNotNull() for n in summary]
    carried = carried.filter(received[0] if len(received) == 1 else F.greatest(*received))
    events = cut.withColumn(carried_side, F.lit(0)).unionByName(
        carried.withColumn(carried_side, F.lit(side)), allowMissingColumns=True)
    window = W.partitionBy(*keys, piece).orderBy(carried_side, *order)
    return events, window, lambda rows: rows.filter(F.col(carried_side) == 0).drop(carried_side, piece)


def _before(w: W) -> W:
    return w.rowsBetween(W.unboundedPreceding, -1)


def _so_far(w: W) -> W:
    return w.rowsBetween(W.unboundedPreceding, W.currentRow)


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Mapping[str, str],
    pieces: int | None = None,
) -> DataFrame:
    """Last non-null value so far per key; ``columns`` maps output name to input column.

    Leading nulls stay null and a value that is present never changes.
    """
    place = F.struct(*order)
    names = {src: free_name(df, f"_f{i}") for i, src in enumerate(dict.fromkeys(columns.values()))}
    summary = {n: F.max_by(src, F.when(F.col(src).isNotNull(), place)) for src, n in names.items()}
    copied = df.withColumns({n: F.col(src) for src, n in names.items()})
    events, w, rows = _with_carry(
        copied, keys, order, pieces, summary, lambda n, along: F.last(n, ignorenulls=True).over(_before(along)), -1)
    filled = events.withColumns({n: F.last(n, ignorenulls=True).over(_so_far(w)) for n in names.values()})
    return rows(filled).withColumns({out: F.col(names[src]) for out, src in columns.items()}).drop(*names.values())


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, alias: str,
    combine: Callable[[str], Column] = F.max, pieces: int | None = None,
) -> DataFrame:
    """``combine`` (``F.max``, ``F.min`` or ``F.sum``) of ``column`` so far per key, the current row included."""
    value, so_far = free_name(df, "_v"), free_name(df, "_r")
    events, w, rows = _with_carry(
        df.withColumn(value, F.col(column)), keys, order, pieces, {value: combine(value)},
        lambda n, along: combine(n).over(_before(along)), -1)
    done = rows(events.withColumn(so_far, combine(value).over(_so_far(w))))
    return done.withColumn(alias, F.col(so_far)).drop(so_far, value)


def _neighbour(df, keys, order, column, alias, pieces, shift, border, side, spread=False):
    # the value is wrapped, so that a carry row with a null value is still a row
    value, moved = free_name(df, "_v"), free_name(df, "_r")
    events, w, rows = _with_carry(
        df.withColumn(value, F.struct(F.col(column).alias("v"))), keys, order, pieces,
        {value: border(value, F.struct(*order))}, lambda n, along: shift(F.col(n)).over(along), side, spread)
    done = rows(events.withColumn(moved, shift(F.col(value)).over(w)))
    return done.withColumn(alias, F.col(moved)["v"]).drop(moved, value)


def next_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, alias: str, pieces: int | None = None,
    spread: bool = False,
) -> DataFrame:
    """``column`` of the following row of the same key, null on the last.

    ``spread`` says that the rows will be multiplied, so their small shuffle partitions are not joined.
    """
    return _neighbour(df, keys, order, column, alias, pieces, F.lead, F.min_by, 1, spread)


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, alias: str, pieces: int | None = None,
) -> DataFrame:
    """``column`` of the preceding row of the same key, null on the first."""
    return _neighbour(df, keys, order, column, alias, pieces, F.lag, F.max_by, -1)
