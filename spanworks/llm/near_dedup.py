"""Near-duplicate groups of documents: HyperMinHash registers, bands, estimates, exact checks.

Each distinct set of five-word shingles is hashed into 384 buckets; a bucket keeps the
leading-zero count and ten further bits of its least hash. Bands of six registers (with
empty ones filled from others) are the join keys. A pair that shares a band is estimated
from the registers, with the expected number of chance matches taken off, and confirmed
on the two whole sets.

Nothing is emitted per pair of a band: each member meets only the least member of its
band first; links found there join components, and only bands of three or more members
whose components still differ are compared within blocks of bounded size.

Cases: null and empty texts and texts without words have an empty set, no links, and are
their own component. Rows repeated with one doc_id count once for the set, and each row
is returned. Rows with a null doc_id have a null component and are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.llm.graph import components, join_dealt_anew
from spanworks.llm.words import column_sets, mix, prepare
from spanworks.workdir import materialize

SHINGLE = 5
#: A pair is linked when 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
#: 64 bands of 6: a pair at the threshold is missed with probability (1 - 0.75^6)^64 < 4e-6.
BANDS, ROWS = 64, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Members of a band compared at once.
BLOCK = 512
_FILL_ROUNDS = 24
_fill = np.random.default_rng(7).integers(0, REGISTERS, (_FILL_ROUNDS, REGISTERS))
_U = np.uint64


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers per set; 0 marks an empty bucket."""
    sizes = np.array([len(s) for s in sets], np.int64)
    least = np.full(len(sets) * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    if sizes.sum():
        values = np.concatenate(sets)
        bucket = ((values >> _U(32)) * _U(REGISTERS)) >> _U(32)
        place = np.repeat(np.arange(len(sets)) * REGISTERS, sizes) + bucket.astype(np.int64)
        np.minimum.at(least, place, mix(values ^ _U(0xA5A5A5A5A5A5A5A5)))
    # frexp gives the position of the leading one; the mantissa follows it
    exponent = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    exponent -= (least < (_U(1) << np.maximum(exponent - 1, 0).astype(np.uint64))) & (exponent > 0)
    zeros = np.clip(64 - exponent, 0, 62)
    mantissa = (least << (zeros + 1).astype(np.uint64)) >> _U(64 - MANTISSA)
    out = ((zeros << MANTISSA) | mantissa.astype(np.int64)) + 1
    out[least == np.iinfo(np.uint64).max] = 0
    return out.astype(np.uint16).reshape(len(sets), REGISTERS)


def filled(rows: np.ndarray) -> np.ndarray:
    """Empty registers take the value of another bucket of the same set, found in a fixed order."""
    out = rows.astype(np.int64)
    full = rows > 0
    open_ = ~full
    for choice in _fill:
        if not open_.any():
            return out
        take = open_ & full[:, choice]
        out[take] = rows[:, choice][take]
        open_ &= ~take
    # the rest takes the next bucket in turn
    at = np.where(full, np.arange(REGISTERS), -1)
    at = np.maximum.accumulate(np.concatenate([at, np.where(full, np.arange(REGISTERS), -1)], 1), 1)[:, REGISTERS:]
    turn = np.take_along_axis(rows, np.maximum(at, 0), 1)
    return np.where(open_, turn, out)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """64-bit keys, one column per band."""
    cells = filled(rows).astype(np.uint64).reshape(len(rows), BANDS, ROWS)
    keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(rows), BANDS)).copy()
    for k in range(ROWS):
        keys = mix(keys + cells[:, :, k] * _U(0xD6E8FEB86659FD93))
    return keys


def may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """False where the sizes, or the estimated similarity by over five deviations, rule a link out.

    The estimate is (matches - chance matches) / buckets filled in either set, with the
    published approximation of chance matches for ``MANTISSA`` bits.
    """
    low, high = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    either = np.maximum(((a > 0) | (b > 0)).sum(1), 1)
    same = ((a == b) & (a > 0)).sum(1)
    ratio = low / np.maximum(high, 1)
    chance = 0.169919487 * REGISTERS / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2
    t = SIMILARITY / 100
    return (100 * low >= SIMILARITY * high) & ((same - chance) / either >= t - 5 * np.sqrt(t * (1 - t) / either) - 1e-9)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), 256):
            part = batch.slice(low, 256)
            sets = list(column_sets(part.column(1), SHINGLE))
            cells = registers(sets)
            with np.errstate(over="ignore"):
                a = [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                b = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(a, pa.int64()),
                 pa.array(b, pa.int64()), pa.array([r.tobytes() for r in cells], pa.binary())],
                ["doc_id", "n_shingles", "set_a", "set_b", "cells"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), 512):
            part = batch.slice(low, 512)
            keys = band_keys(_matrix(part.column(1)))
            ids = np.repeat(np.array(part.column(0).to_pylist(), np.int64), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "rep"])


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs (u, v) that may link; columns u, v, n_u, cells_u, n_v, cells_v."""
    for batch in batches:
        if not len(batch):
            continue
        sizes = [batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 4)]
        keep = may_link(_matrix(batch.column(3)), _matrix(batch.column(5)), *sizes)
        yield batch.select(["u", "v"]).filter(pa.array(keep))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """The link test on whole sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= SIMILARITY * (len(a) + len(b) - common)


class Run:
    """The members of one band, or of two of its blocks, compared in memory.

    A pair is looked at in the first band that it shares, unless known to be in one
    component; estimates rule out most pairs, the whole sets decide on the rest.
    """

    def __init__(self, rows: list[tuple]):
        self.key = np.int64(rows[0][0])
        self.block, self.component, self.size = (np.array([r[k] for r in rows], np.int64) for k in (3, 5, 6))
        self.pair = rows[0][1:3]
        self.cells = np.frombuffer(b"".join(r[7] for r in rows), np.uint16).reshape(len(rows), REGISTERS)
        self.keys = band_keys(self.cells).view(np.int64)
        self.texts, self.sets = [r[8] for r in rows], {}

    def words(self, k: int) -> np.ndarray:
        if k not in self.sets:
            self.sets[k] = next(column_sets(pa.array([self.texts[k]], pa.string()), SHINGLE))
        return self.sets[k]

    def links(self) -> Iterator[tuple[int, int]]:
        """Pairs of components, the larger first, that a link joins."""
        i, j = self.pair
        left = np.flatnonzero(self.block == i)
        right = left if i == j else np.flatnonzero(self.block == j)
        for n, at in enumerate(left):
            other = right[n + 1 :] if i == j else right
            other = other[self.component[other] != self.component[at]]
            if not len(other):
                continue
            other = other[may_link(self.cells[[at]], self.cells[other], self.size[[at]], self.size[other])]
            shared = self.keys[other] == self.keys[at]
            band = np.argmax(self.keys[at] == self.key)
            for o in other[np.argmax(shared, 1) == band] if len(other) else ():
                u, v = self.component[at], self.component[o]
                if u != v and linked(self.words(at), self.words(o)):
                    yield int(max(u, v)), int(min(u, v))
                    self.component[self.component == max(u, v)] = min(u, v)


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between components from sorted runs of (key, i, j); see ``Run`` for the other columns."""
    run, at, found = [], None, set()
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != at:
                if run:
                    found.update(Run(run).links())
                run, at = [], row[:3]
            run.append(row)
    if run:
        found.update(Run(run).links())
    rows = sorted(found)
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["u", "v"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs that link on their whole sets; columns u, v, text_u, text_v."""
    for batch in batches:
        keep = [linked(a, b) for a, b in zip(column_sets(batch.column(2), SHINGLE), column_sets(batch.column(3), SHINGLE))]
        yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _linked(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose documents link; estimates first, then whole sets."""
    cells = classes.select("rep", "n_shingles", "cells")
    for side in ("u", "v"):
        pairs = pairs.join(cells.toDF(side, f"n_{side}", f"cells_{side}"), side)
    pairs = pairs.select("u", "v", "n_u", "cells_u", "n_v", "cells_v").mapInArrow(_estimate, "u long, v long")
    for side in ("u", "v"):
        pairs = pairs.join(texts.toDF(side, f"text_{side}"), side)
    return pairs.select("u", "v", "text_u", "text_v").mapInArrow(_confirm, "u long, v long")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id long, text, ...)."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = materialize(
        texts.mapInArrow(_fingerprints, "doc_id long, n_shingles long, set_a long, set_b long, cells binary"), "prints")
    same = ["set_a", "set_b", "n_shingles"]
    classes = materialize(
        prints.where("n_shingles > 0 and doc_id is not null").groupBy(*same)
        .agg(F.min("doc_id").alias("rep"), F.first("cells").alias("cells")), "classes")
    bands = classes.select("rep", "cells").mapInArrow(_bands, "key long, rep long")
    tops = bands.groupBy("key").agg(F.min("rep").alias("top"), F.count(F.lit(1)).alias("members")).where("members > 1")
    members = materialize(join_dealt_anew(bands, tops, "key"), "bands")

    # texts of all documents that share a band with another; never a broadcast, whatever the size
    involved = members.select(F.col("rep").alias("doc_id")).distinct()
    some = materialize(texts.join(involved.hint("merge"), "doc_id", "left_semi"), "texts")

    stars = members.where("rep <> top").select(F.col("rep").alias("u"), F.col("top").alias("v")).distinct()
    parts = materialize(components(_linked(stars, classes, some)), "parts")

    # bands that are not yet in one component: exact comparison within blocks
    wide = members.where("members > 2").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    wide = materialize(wide.select("key", "rep", "members", F.coalesce("component", "rep").alias("component")), "wide")
    # the largest component of a band is "in"; what is "out" meets everything, "in" meets "out" alone
    split = (
        wide.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
        .agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all")).where("main.n < all")
        .select("key", F.col("main.component").alias("main"),
                F.ceil((F.col("all") - F.col("main.n")) / block).cast("int").alias("outs"),
                F.ceil(F.col("main.n") / block).cast("int").alias("ins"))
    )
    out, spread = F.col("component") != F.col("main"), F.xxhash64("rep")
    todo = (
        join_dealt_anew(wide, split, "key")
        .withColumn("block", F.when(out, F.pmod(spread, "outs")).otherwise(F.col("outs") + F.pmod(spread, "ins")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(out, F.col("outs") + F.col("ins")).otherwise(F.col("outs")) - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "component")
        .join(classes.select("rep", "n_shingles", "cells"), "rep")
        .join(some.withColumnRenamed("doc_id", "rep"), "rep")
        .select("key", "i", "j", "block", "rep", "component", "n_shingles", "cells", "text")
        .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    )
    more = materialize(todo.mapInArrow(_compare_blocks, "u long, v long").distinct(), "links")
    final = parts
    if not more.isEmpty():
        joined = components(more).toDF("component", "least")
        classes_of = classes.select(F.col("rep").alias("node")).join(parts, "node", "left")
        classes_of = classes_of.select("node", F.coalesce("component", "node").alias("component"))
        final = classes_of.join(joined, "component", "left").select("node", F.coalesce("least", "component").alias("component"))

    reps = (
        classes.select(*same, "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
        .select(*[F.col(c).alias(f"_{c}") for c in same], F.coalesce("component", "rep").alias("component_id"))
    )
    match = [F.col(c) == F.col(f"_{c}") for c in same]
    return prints.drop("cells").join(reps, match, "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its group, columns unchanged."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
