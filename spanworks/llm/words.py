"""Words of many texts at once, as numpy arrays inside Spark tasks.

Texts come from Arrow batches and are taken in pieces of bounded size; within a
piece all work is done on byte positions, without a Python object per word. A
word is a maximal run of characters other than space and 0x09-0x0D.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text taken at once; a longer text is a piece of its own.
PIECE = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd constants of the hash functions.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = np.full(size, _BASE), np.full(size, inverse)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its texts; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[bounds[0] : bounds[-1]], bounds - bounds[0]


def text_pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, bounds) of pieces of about ``size`` bytes."""
    data, bounds = text_bytes(column)
    low, rows = 0, len(bounds) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + size, "right")) - 1)
        high = min(high, rows, low + 20_000)
        yield low, high, data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        low = high


@dataclass
class Words:
    """Words ``first[i]:first[i + 1]`` are those of text ``i``; start and end are byte positions."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> Words:
    data = _LOWER[data] if lower else data
    inside = ~_SPACE[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    real = bounds[:-1] < bounds[1:]
    before[bounds[:-1][real]] = False
    after[bounds[1:][real] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, bounds, start, end, np.searchsorted(start, bounds))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)


def word_hashes(words: Words) -> np.ndarray:
    return range_hashes(words.data, words.start, words.end)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` items, by its first position; runs over the end are left out."""
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, np.uint64(size))
    for k in range(size):
        out = out * _STEP + hashes[k : k + n]
    return mix(out)


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct hashes of its ``size``-word shingles.

    A text with fewer words has its whole sequence as the one shingle; a text without
    words has none.
    """
    hashes = word_hashes(words)
    runs = window_hashes(hashes, size)
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if high - low >= size:
            yield distinct(runs[low : high - size + 1])
        elif high > low:
            yield window_hashes(hashes[low:high], high - low)
        else:
            yield np.zeros(0, np.uint64)


def column_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """``shingle_sets`` of a whole string column, lower-cased."""
    for _, _, data, bounds in text_pieces(column):
        yield from shingle_sets(split_words(data, bounds), size)


def crc32_rest(ids: pa.Array, parts: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``parts``; -1 for null."""
    return np.array([-1 if i is None else zlib.crc32(str(i).encode()) % parts for i in ids.to_pylist()], np.int64)


def with_fold(df: DataFrame, parts: int, name: str = "fold") -> DataFrame:
    """The same remainder as a column expression."""
    return df.withColumn(name, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)).cast("int"))


def prepare(spark: SparkSession) -> None:
    """Arrow batches of at most 8 MB, and this package on the workers' path.

    The package is sent along unless the workers find it by PYTHONPATH or by the
    working directory.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    root = Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if any(p and Path(p).resolve() == root for p in known) or getattr(context, "_spanworks_sent", False):
        return
    archive = f"{tempfile.mkdtemp()}/spanworks_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in (root / "spanworks").rglob("*"):
            if path.suffix in (".py", ".txt"):
                z.write(path, path.relative_to(root))
    context.addPyFile(archive)
    context._spanworks_sent = True
