"""Hard negatives of anchors, by a secondary sort of pair scores.

A pair of an anchor and another row is one key: anchor, descending score, whether the row has
another label, id. The keys are dealt out by anchor and sorted within partitions; an iterator
then goes down the scores of an anchor, opens a window of scores for each positive it meets,
and hands out negatives while a window is open. It holds the open windows, never an anchor's
pairs.

The pairs come from a stated set of anchors against all rows: rows are dealt evenly to groups of
bounded size, and a group in memory meets blocks of anchors that stream past. A first pass finds
the positives, so that the second sends on only rows that can still be among the first of some
window: the best of the group within each window, in the order of the keys. No such row is lost,
as a row that is not among the first of its group cannot be among the first of all.

Cases: rows with a null vec_id, label or vector, or with a component that is null or not finite,
take no part. Shorter vectors count as filled with zeros. Equal scores are taken by smaller
vec_id. Rows that repeat a vec_id are all candidates, but never for the anchor of that id, which
is asked once (by its least label and vector). An anchor without positives, or a positive without
negatives in its window (as below a negative score, where the window is empty), gives no rows.
Scores must fit 62 bits: longer vectors end in a ValueError. Columns other than vec_id, embedding
and label are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanworks.llm.words import prepare
from spanworks.workdir import materialize

POSITIVES, NEGATIVES, STEP, SCALE = 5, 10, 100, 256
#: Percent of a positive's score from which and up to which a negative's score lies.
LOW, HIGH = 30, 90
#: Rows of a group held in memory, and anchors compared with it at once.
GROUP, ANCHORS = 8192, 128

_SIGN = np.uint64(1 << 63)
_NONE = np.iinfo(np.int64).min
_KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("other", "u1"), ("id", ">u8")])


def pack(anchors: np.ndarray, scores: np.ndarray, other: int, ids: np.ndarray) -> pa.Array:
    """Keys whose order as bytes is anchor, descending score, positives before negatives, id."""
    keys = np.empty(len(anchors), _KEY)
    keys["anchor"] = anchors.astype(np.int64).view(np.uint64) ^ _SIGN
    keys["score"] = ~(scores.astype(np.int64).view(np.uint64) ^ _SIGN)
    keys["other"] = other
    keys["id"] = ids.astype(np.int64).view(np.uint64) ^ _SIGN
    return pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(_KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(column.to_pylist()), _KEY)
    back = lambda x: (x.astype(np.uint64) ^ _SIGN).view(np.int64)
    return back(keys["anchor"]), back(~keys["score"].astype(np.uint64)), keys["other"], back(keys["id"])


def _numbers(scale: int):
    """(vec_id, label, width, norm, cells) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, label, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if i is None or label is None or not vector.is_valid or vector.values.null_count:
                    continue
                x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    x = np.floor(scale * x)
                    norm = float(np.sqrt((x * x).sum()))
                    if not norm < 2**31:
                        raise ValueError(f"the vector of vec_id {i} is too long for scores of 62 bits")
                    rows.append((i, label, len(x), norm, x.astype("<i8").tobytes()))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["vec_id", "label", "width", "norm", "cells"])

    return run


def _matrix(cells: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(cells), width), np.int64)
    for n, cell in enumerate(cells):
        row = np.frombuffer(cell, "<i8")
        out[n, : len(row)] = row
    return out


def _gathered(width: int, size: int, windows: int):
    """Rows (number, ids, labels, cells, scores) of up to ``size`` input rows, in the order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId(), []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            rows.sort(key=lambda r: r[0])
            cells = [
                np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], "<i8"),
                _matrix([r[2] for r in rows], width).astype("<i8"),
                np.array([[*r[3], *[_NONE] * (windows - len(r[3]))] for r in rows] if windows else [], "<i8"),
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
                names=["number", "ids", "labels", "cells", "scores"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == size:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return run


_BLOCK = "number int, ids binary, labels binary, cells binary, scores binary"


def first_of_rows(scores: np.ndarray, allowed: np.ndarray, k: int, packs: bool) -> np.ndarray:
    """Of each row, a mask of the ``k`` best allowed columns: higher scores first, then earlier columns."""
    n = scores.shape[1]
    out = np.zeros(scores.shape, bool)
    if packs:
        keys = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), _NONE)
        best = np.argpartition(keys, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), scores.shape)
        np.put_along_axis(out, best, True, axis=1)
        return out & allowed
    for row in range(len(scores)):
        columns = np.flatnonzero(allowed[row])
        out[row, columns[np.lexsort((columns, -scores[row, columns]))[:k]]] = True
    return out


def bounds(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and largest whole score in the window of a positive."""
    return -(-low * positive // 100), high * positive // 100


def _met(width: int, longest: float, positives: int, negatives: int, low: int, high: int, second: bool):
    """Keys of the pairs of a group and the anchors after it that can be among the first.

    In the first pass rows of the same label, in the second those of other labels within the
    windows of the anchor's positives.
    """
    exact = longest * longest < 2.0**52  # then sums of products are whole in doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, packs = None, None, None, False
        kind = np.float64 if exact else np.int64
        for batch in batches:
            for number, is_anchor, *cells in zip(*(c.to_pylist() for c in batch.columns)):
                own_ids, own_labels = (np.frombuffer(c, "<i8") for c in cells[:2])
                matrix = np.frombuffer(cells[2], "<i8").reshape(len(own_ids), width).astype(kind)
                if not is_anchor:
                    ids, labels, vectors, group = own_ids, own_labels, matrix.T.copy(), number
                    packs = (longest * longest + 1) * (len(ids) + 1) < 2.0**62
                    continue
                if ids is None or group != number:
                    continue  # no rows were dealt to this group
                scores = np.rint(matrix @ vectors).astype(np.int64) if exact else matrix @ vectors
                same = own_labels[:, None] == labels[None, :]
                apart = own_ids[:, None] != ids[None, :]
                if not second:
                    chosen = first_of_rows(scores, same & apart, positives, packs)
                else:
                    chosen = np.zeros(scores.shape, bool)
                    wanted = np.frombuffer(cells[3], "<i8").reshape(len(own_ids), positives)
                    for column in range(positives):
                        limits = [bounds(p, low, high) if p != _NONE else (1, 0) for p in wanted[:, column].tolist()]
                        least, most = (np.array(x, np.int64)[:, None] for x in zip(*limits))
                        inside = ~same & apart & (scores >= least) & (scores <= most)
                        chosen |= first_of_rows(scores, inside, negatives, packs)
                rows, columns = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays(
                    [pack(own_ids[rows], scores[rows, columns], int(second), ids[columns])], names=["key"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchors, scores, _, ids = unpack(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(scores), pa.array(ids), batch.column(0)], names=["anchor", "score", "id", "key"])


def mined(keys: Iterator[tuple[int, int, int, int]], negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows (anchor, positive, rank, negative, positive score, negative score) from sorted keys.

    Scores of an anchor fall, so a window opens with its positive and never opens again.
    """
    current, windows = None, []
    for anchor, score, other, row in keys:
        if anchor != current:
            current, windows = anchor, []
        if not other:
            windows.append([row, score, *bounds(score, low, high), 0])
            continue
        shut = False
        for window in windows:
            positive, positive_score, least, most, given = window
            if least <= score <= most and given < negatives:
                window[4] = given + 1
                yield anchor, positive, given + 1, row, positive_score, score
            shut |= score < least or window[4] == negatives
        if shut:
            windows = [w for w in windows if score >= w[2] and w[4] < negatives]


def _mine(negatives: int, low: int, high: int):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        keys = (key for batch in batches for key in zip(*(x.tolist() for x in unpack(batch.column(0)))))
        held = []
        for row in mined(keys, negatives, low, high):
            held.append(row)
            if len(held) == 1 << 14:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    return run


def mine(
    vectors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, step: int = STEP,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, group: int = GROUP, block: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors`` has vec_id, embedding and label; each component x counts as floor(``scale`` * x).
    Anchors are the rows whose vec_id is divisible by ``step``; their positives are their first
    ``positives`` other rows of the same label, and a positive gets the first ``negatives`` rows of
    other labels whose score is ``low`` to ``high`` percent of its own.
    """
    spark = vectors.sparkSession
    prepare(spark)
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    numbers = materialize(plain.mapInArrow(_numbers(scale), "vec_id long, label long, width int, norm double, cells binary"), "vectors")
    sizes = numbers.agg(F.count(F.lit(1)).alias("n"), F.max("width").alias("width"), F.max("norm").alias("norm")).first()
    width, longest, groups = sizes.width or 0, sizes.norm or 0.0, max(1, -(-sizes.n // group))

    none = F.array().cast("array<long>")
    dealt = numbers.select("vec_id", "label", "cells", none.alias("scores")).repartition(groups)
    rows = materialize(dealt.mapInArrow(_gathered(width, 1 << 62, 0), _BLOCK), "groups")
    rows = rows.select("number", F.lit(False).alias("anchor"), "ids", "labels", "cells", "scores")
    asked = numbers.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min(F.struct("label", "cells")).alias("v"))
    asked = materialize(asked.select("vec_id", "v.label", "v.cells"), "anchors")

    def pairs(anchors: DataFrame, second: bool) -> DataFrame:
        """Every group followed by all blocks of anchors, and the keys that are left of their pairs."""
        blocks = anchors.mapInArrow(_gathered(width, block, positives if second else 0), _BLOCK)
        blocks = blocks.withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
            "number", F.lit(True).alias("anchor"), "ids", "labels", "cells", "scores")
        met = rows.unionByName(blocks).repartition("number").sortWithinPartitions("number", "anchor")
        return met.mapInArrow(_met(width, longest, positives, negatives, low, high, second), "key binary")

    first = pairs(asked.select("vec_id", "label", "cells", none.alias("scores")), False)
    order = Window.partitionBy("anchor").orderBy("key")
    found = first.mapInArrow(_unpacked, "anchor long, score long, id long, key binary")
    found = materialize(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"), "positives")
    wanted = found.groupBy(F.col("anchor").alias("vec_id")).agg(F.collect_list("score").alias("scores"))  # a few for each anchor
    second = pairs(asked.join(wanted, "vec_id").select("vec_id", "label", "cells", "scores"), True)
    keys = found.select("key").unionByName(second)
    keys = keys.repartition(F.substring("key", 1, 8)).sortWithinPartitions("key")
    return keys.mapInArrow(
        _mine(negatives, low, high),
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
