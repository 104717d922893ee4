"""Best-fit packing of tokenized documents into sequences of bounded length.

Bounded-space online best fit: a fixed number of sequences stays open, a bitset keyed by
free space finds the open one that a piece leaves fullest, and when too many are open the
fullest is closed. Every partition packs its own share, which costs at most its open
sequences; partitions are few and large.

Cases: a null or empty text is one piece holding the end id alone. Only documents longer
than a sequence are cut. Repeated rows are packed once each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.llm.tokens import Coder, column_ids, load
from spanworks.llm.words import prepare
from spanworks.workdir import materialize

LENGTH = 2048
#: Sequences open at a time.
OPEN = 2048
#: Pieces that one task packs.
SHARE = 200_000
END_ID = 0
# Fixed value: the pattern by which the tokenizer's file splits lower-cased text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open sequences by free space; bit ``f`` of ``mask`` tells whether one with ``f`` free is open."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open, self.next, self.mask = length, most, 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _put(self, number: int, free: int) -> None:
        if not free:
            return
        self.by_free[free].append(number)
        self.mask |= 1 << free
        self.open += 1
        if self.open > self.most:
            self._take((self.mask & -self.mask).bit_length() - 1)

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of ``size`` tokens."""
        fits = self.mask >> size
        if fits:
            free = (fits & -fits).bit_length() - 1 + size
            number = self._take(free)
        else:
            free, number = self.length, self.next
            self.next += 1
        self._put(number, free - size)
        return number, self.length - free


def _pieces(path: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(load(path), SPLIT, lower=True)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), column_ids(batch.column(1), coder)):
                ids = np.append(ids, np.uint32(END_ID))
                for n, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    rows.append((doc, n, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in PIECES.split(", ")])

    return run


def _pack(length: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(length, most), TaskContext.get().partitionId() << 40
        for batch in batches:
            places = [bins.place(size) for size in batch.column("length").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())],
                names=[*batch.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, most_open: int = OPEN, share: int = SHARE) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text, ...): where it lies in which sequence.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    prepare(docs.sparkSession)
    path = path or public_tokenizers.path("word_bpe_49k.json")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(texts.mapInArrow(_pieces(path, length), PIECES), "pieces")
    parts = max(1, -(-pieces.count() // share))
    order = F.xxhash64("doc_id", "piece")
    return (
        pieces.withColumn("_order", order)
        .repartition(parts, "_order").sortWithinPartitions("_order", "doc_id", "piece", "ids_crc32").drop("_order")
        .mapInArrow(_pack(length, most_open), PIECES + ", sequence_id long, offset long")
    )
