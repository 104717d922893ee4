"""Exact top-k search by inner product, for a stated set of queries against all vectors.

Vectors are put in blocks by descending length. A small block of the longest gives each
query a first bound: the k-th best score in it. A block of queries meets a block of
vectors only if the largest length there can reach the bound of some query. Within two
blocks, vectors are taken by descending length; partial sums over the first rotated
components plus the Cauchy-Schwarz bound of the rest rule pairs out, the remaining scores
are computed exactly on whole numbers, and the bounds rise as better scores come.

The rotation comes from a singular value decomposition of at most ``SAMPLE`` vectors and
affects speed alone.

Cases: vectors that are null, or hold a null or a component that is not finite, take no
part. Shorter vectors count as filled with zeros. Among equal scores the smaller vec_id
comes first. Rows that repeat a vec_id are all candidates, but never for the query of that
id, which is asked once (by its least vector). Rows with a null vec_id take no part.
Scores must fit 62 bits: a longer vector ends in a ValueError.
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

K, STEP, SCALE = 5, 50, 256
#: Vectors of a block, queries of a block, vectors that fit the rotation, vectors compared at once.
BLOCK, QUERIES, SAMPLE, CHUNK = 4096, 512, 2048, 512
#: Share of the components summed before the bound is tried.
HEAD = 4
_PAIR = "query long, vec_id long, score long"


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, width, norm, cells) of valid vectors: whole numbers and their length."""
    for batch in batches:
        rows = []
        for i, vector in zip(batch.column(0).to_pylist(), batch.column(1)):
            if i is None or not vector.is_valid or vector.values.null_count:
                continue
            x = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all():
                x = np.floor(SCALE * x)
                norm = float(np.sqrt((x * x).sum()))
                if not norm < 2**31:
                    raise ValueError(f"the vector of vec_id {i} is too long for scores of 62 bits")
                rows.append((i, len(x), norm, x.astype("<i8").tobytes()))
        columns = list(zip(*rows)) or [[]] * 4
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["vec_id", "width", "norm", "cells"])


def _matrix(cells: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(cells), width), np.int64)
    for n, cell in enumerate(cells):
        row = np.frombuffer(cell, "<i8")
        out[n, : len(row)] = row
    return out


def _blocks(size: int, width: int, bound: int | None):
    """Rows (block, most, ids, cells[, bounds]) of up to ``size`` sorted input rows; ``most`` is column ``bound`` of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def block(rows: list[tuple]) -> pa.RecordBatch:
            bounds = np.array([r[3] for r in rows], "<i8").tobytes() if bound is not None else b""
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([rows[0][1]], pa.float64()),
                 pa.array([np.array([r[0] for r in rows], "<i8").tobytes()], pa.binary()),
                 pa.array([_matrix([r[2] for r in rows], width).astype("<i8").tobytes()], pa.binary()),
                 pa.array([bounds], pa.binary())], names=["block", "most", "ids", "cells", "bounds"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == size:
                    yield block(held)
                    number, held = number + 1, []
        if held:
            yield block(held)

    return run


class Best:
    """The best ``k`` (score, vec_id) of each query so far, and the score that the next must reach."""

    def __init__(self, queries: int, k: int, bounds: np.ndarray):
        self.k, self.bounds = k, bounds.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(queries)]

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids, -scores))[: self.k]
        best = sorted([*self.found[query], *zip((-scores[order]).tolist(), ids[order].tolist())])[: self.k]
        self.found[query] = best
        if len(best) == self.k:
            self.bounds[query] = max(self.bounds[query], -best[-1][0])


def compare(query_ids, queries, bounds, ids, vectors, rotation: np.ndarray, k: int) -> Best:
    """Searches vectors sorted by descending length; ``bounds`` are scores that k others reach already."""
    best, head = Best(len(query_ids), k, bounds), max(1, queries.shape[1] // HEAD)
    q, v = queries @ rotation, vectors @ rotation
    q_norm, v_norm = (np.sqrt((m * m).sum(1)) for m in (q, v))
    q_rest, v_rest = (np.sqrt((m[:, head:] ** 2).sum(1)) for m in (q, v))
    for low in range(0, len(ids), CHUNK):
        part = slice(low, low + CHUNK)
        slack = 1e-9 * q_norm * v_norm[low] + 1e-3
        on = np.flatnonzero(q_norm * v_norm[low] + slack >= best.bounds)
        if not len(on):
            break  # the rest is shorter still
        upper = q[on, :head] @ v[part, :head].T + q_rest[on, None] * v_rest[part][None, :]
        hit = upper + slack[on, None] >= best.bounds[on, None]
        hit &= ids[part][None, :] != query_ids[on, None]
        for n, query in enumerate(on):
            at = np.flatnonzero(hit[n])
            if len(at):
                scores = vectors[part][at] @ queries[query]
                good = scores >= best.bounds[query]
                best.add(query, ids[part][at][good], scores[good])
    return best


def _rotation(sample: list[bytes], width: int) -> np.ndarray:
    if not sample or not width:
        return np.eye(width)
    return np.linalg.svd(_matrix(sample, width).astype(np.float64), full_matrices=True)[2].T


_NONE = np.iinfo(np.int64).min


def _seeded(seed_ids: np.ndarray, seed: np.ndarray, rotation: np.ndarray, k: int):
    """(vec_id, need, cells, bound): the k-th best score among the seeds, and the length that a better vector needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells = np.array(batch.column(0).to_pylist(), np.int64), batch.column(2).to_pylist()
            bounds = np.full(len(ids), _NONE)
            queries = _matrix(cells, seed.shape[1])
            for low in range(0, len(ids), QUERIES):
                part = slice(low, low + QUERIES)
                bounds[part] = compare(ids[part], queries[part], bounds[part], seed_ids, seed, rotation, k).bounds
            norm = np.array(batch.column(1).to_pylist(), np.float64)
            need = np.where((bounds > 0) & (norm > 0), bounds / np.maximum(norm, 1e-9), 0) * (1 - 1e-9)
            need[bounds == _NONE] = 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(need), batch.column(2), pa.array(bounds)], names=["vec_id", "need", "cells", "bound"])

    return run


def _search(width: int, rotation: np.ndarray, k: int):
    """Rows of (ids, cells, bounds) of a query block and (ids, cells) of a vector block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_cells, bounds, ids, cells in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, bounds, ids = (np.frombuffer(b, "<i8") for b in (q_ids, bounds, ids))
                queries, vectors = (np.frombuffer(b, "<i8").reshape(len(n), width) for b, n in ((q_cells, q_ids), (cells, ids)))
                best = compare(q_ids, queries, bounds, ids, vectors, rotation, k)
                rows = [(int(q), i, -s) for q, found in zip(q_ids, best.found) for s, i in found]
                columns = list(zip(*rows)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = K, step: int = STEP, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the best ``k`` others for each vec_id divisible by ``step``.

    ``vectors`` has vec_id and embedding; each component x counts as floor(256 x).
    """
    spark = vectors.sparkSession
    prepare(spark)
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    numbers = materialize(plain.mapInArrow(_numbers, "vec_id long, width int, norm double, cells binary"), "vectors")
    width = numbers.agg(F.max("width")).first()[0] or 0
    sample = numbers.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("cells").collect()
    rotation = _rotation(sorted(bytes(r.cells) for r in sample), width)
    longest = numbers.orderBy(F.desc("norm"), "vec_id", "cells").limit(CHUNK).select("vec_id", "cells").collect()
    seed_ids = np.array([r.vec_id for r in longest], np.int64)
    seed = _matrix([bytes(r.cells) for r in longest], width)

    schema = "block long, most double, ids binary, cells binary, bounds binary"
    blocks = materialize(
        numbers.select("vec_id", "norm", "cells").repartitionByRange(F.desc("norm"), "vec_id")
        .sortWithinPartitions(F.desc("norm"), "vec_id").mapInArrow(_blocks(block, width, None), schema), "blocks")
    asked = numbers.where(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min(F.struct("norm", "cells")).alias("v"))
    asked = asked.select("vec_id", "v.norm", "v.cells").mapInArrow(
        _seeded(seed_ids, seed, rotation, k), "vec_id long, need double, cells binary, bound long")
    asked = materialize(
        asked.repartitionByRange("need", "vec_id").sortWithinPartitions("need", "vec_id")
        .mapInArrow(_blocks(queries, width, 3), schema), "queries")

    # which blocks meet: by number and length alone, then the blocks themselves by number
    pairs = asked.select(F.col("block").alias("q"), F.col("most").alias("need")).join(
        blocks.select(F.col("block").alias("v"), "most"), F.col("most") >= F.col("need")).select("q", "v")
    both = (
        pairs.join(asked.select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"), "bounds"), "q")
        .join(blocks.select(F.col("block").alias("v"), "ids", "cells"), "v")
        .select("q_ids", "q_cells", "bounds", "ids", "cells")
    )
    found = both.mapInArrow(_search(width, rotation, k), _PAIR)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", "vec_id", "score")
