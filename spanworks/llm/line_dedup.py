"""Removal of repeated and nearly repeated lines over the whole corpus.

A line is the text between line feeds; its words are compared with A-Z in lower case.
Lines of at least ``MIN_WORDS`` words are near duplicates when one word inserted, deleted
or replaced turns one into the other. A line goes when an earlier line, by (doc_id, line
number), is equal or a near duplicate; of shorter ones, those of at least ``exact_words``
words go when equal to an earlier line, and the others stay.

Deletion neighbourhood: a line has one variant per deleted word. Two lines of equal length
are within one replacement exactly when their variants for the same place are equal; a
line is one insertion away from a shorter one exactly when one of its variants equals that
line. So all members of a variant's group are near duplicates, and the earliest of the
group is enough: nothing is emitted per pair. Variants are made only for distinct lines
that share one of their halves with another line of fitting length, which near duplicates
always do. Matches of hashed variants are verified on the words.

Cases: null texts and lines without words are kept as they are. Rows with a null doc_id
take no part. Rows that repeat a doc_id with the same text count as one; with another
text, they are ordered by a hash of it. Columns other than doc_id and text pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanworks.llm.graph import join_dealt_anew
from spanworks.llm.words import mix, powers, prepare, split_words, text_pieces, word_hashes
from spanworks.workdir import materialize

MIN_WORDS = 5
_PREFIX, _SUFFIX, _WHOLE, _SWAP = (np.array([k], np.uint64) for k in (0x51ED270B, 0x2545F491, 0x9FB21C65, 0x6C078965))
_K = np.uint64(0xD6E8FEB86659FD93)


class Runs:
    """Hashes of word ranges of one piece of text, by prefix sums."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = powers(len(hashes) + 1)
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.sums[1:])

    def plain(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def _key(value: np.ndarray, kind: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(mix(value + kind * _K) + size.astype(np.uint64) * _K)


def half_keys(runs: Runs, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """For the lengths ``size`` and ``size - 1``: the key of the first half, and of the last words beyond it."""
    out = []
    for length in (size, size - 1):
        half = length // 2
        out.append(_key(runs.plain(start, start + half), _PREFIX, length))
        out.append(_key(runs.plain(start + size - (length - half), start + size), _SUFFIX, length))
    return out


def _lines(min_words: int):
    names = ["doc_id", "th", "line", "size", "whole", "p0", "s0", "p1", "s1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, hashes = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for low, high, data, bounds in text_pieces(batch.column(2)):
                breaks = np.flatnonzero(data == 10) + 1
                edges = np.sort(np.concatenate([bounds, breaks]))
                words = split_words(data, edges)
                size = words.counts
                keep = np.flatnonzero(size >= min_words)
                if not len(keep):
                    continue
                begin = edges[:-1][keep]
                owner = np.searchsorted(bounds, begin, "right") - 1
                number = np.searchsorted(breaks, begin, "right") - np.searchsorted(breaks, bounds[owner], "right")
                runs = Runs(word_hashes(words))
                start, size = words.first[:-1][keep], size[keep]
                whole = _key(runs.plain(start, start + size), _WHOLE, size)
                owner = owner + low
                longs = [whole, *half_keys(runs, start, size)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs[owner].astype(np.int64)), pa.array(hashes[owner].astype(np.int64)),
                     pa.array(number.astype(np.int32)), pa.array(size.astype(np.int32)),
                     *[pa.array(x.view(np.int64)) for x in longs]], names=names)

    return run, ", ".join(f"{n} {'int' if n in ('line', 'size') else 'long'}" for n in names)


def _pick_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(whole, line text) from rows of (text, lines, wholes)."""
    for batch in batches:
        rows = []
        for text, numbers, wholes in zip(*(c.to_pylist() for c in batch.columns)):
            lines = text.split("\n")
            rows += [(w, lines[n]) for n, w in zip(numbers, wholes)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["whole", "words"])


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, kind, whole, place) from rows of (whole, words, which variants are wanted, place).

    ``same_p`` etc. tell whether the first or the last half met a line of the same length,
    one word shorter, or one word longer; the deleted word then lies in the other half.
    """
    for batch in batches:
        flags = [batch.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in range(2, 7)]
        for low, high, data, bounds in text_pieces(batch.column(1), 1 << 18):
            words = split_words(data, bounds)
            runs, first = Runs(word_hashes(words)), words.first
            size = words.counts
            same_p, same_s, short_p, short_s, longer = (f[low:high] for f in flags)
            row = np.repeat(np.arange(high - low), size)
            place = np.arange(len(row)) - first[row]
            at, a, b = np.arange(len(row)), first[row], first[row + 1]
            n = size[row]
            rest = runs.plain(a, at) + runs.plain(np.minimum(at + 1, b), b) * powers(int(n.max(initial=0)) + 2)[0][place]
            swap = np.where(place >= n // 2, same_p[row], same_s[row])
            cut = ((place >= (n - 1) // 2) & short_p[row]) | ((place <= (n - 1) // 2) & short_s[row])
            keys = [
                mix(_key(rest, _SWAP, n) + place.astype(np.uint64))[swap],
                _key(rest, _WHOLE, n - 1)[cut],
                _key(runs.plain(first[:-1], first[1:]), _WHOLE, size)[longer],
            ]
            rows = [row[swap], row[cut], np.flatnonzero(longer)]
            kind = np.repeat([0, 1, 2], [len(r) for r in rows])
            names = ["whole", "doc_id", "th", "line"]  # and never the text, which would be repeated per variant
            part = batch.select(names).slice(low, high - low).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(kind.astype(np.int32)), *part.columns],
                names=["key", "kind", *names])


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether one word inserted, deleted or replaced, or none, turns ``a`` into ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)):] == b[k + 1 :]


_LOWER = {c: c + 32 for c in range(65, 91)}


def line_words(text: str) -> list[str]:
    return text.translate(_LOWER).encode().split()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wholes of pairs (whole, words, earlier words) within the bound."""
    for batch in batches:
        a, b = (map(line_words, batch.column(k).to_pylist()) for k in (1, 2))
        keep = [within_one_edit(x, y) for x, y in zip(a, b)]
        yield batch.select([0]).filter(pa.array(keep, pa.bool_()))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, exact_words: int = 1) -> DataFrame:
    """(doc_id, th, line): the lines, counted from 0, that repeat an earlier one; ``th`` is a hash of the text."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").where(
        "doc_id is not null and text is not null")
    scan, schema = _lines(min(min_words, exact_words))
    lines = materialize(texts.mapInArrow(scan, schema), "lines")
    place = F.struct("doc_id", "th", "line")
    halves = ["p0", "s0", "p1", "s1"]
    unique = materialize(
        lines.groupBy("whole").agg(
            F.min(place).alias("place"), F.max(place).alias("last"), F.first("size").alias("size"),
            *[F.first(h).alias(h) for h in halves]), "unique")

    # halves shared by two distinct lines of fitting length
    keyed = unique.where(F.col("size") >= min_words).select("whole", F.posexplode(F.array(*halves)).alias("kind", "key"))
    groups = keyed.groupBy("key").agg(
        F.sum((F.col("kind") < 2).cast("int")).alias("shorter"), F.sum((F.col("kind") > 1).cast("int")).alias("longer"),
    ).where("shorter > 1 or (shorter > 0 and longer > 0)")
    met = join_dealt_anew(keyed, groups, "key")
    wanted = met.groupBy("whole").agg(
        F.max((F.col("kind") == 0) & (F.col("shorter") > 1)).alias("same_p"),
        F.max((F.col("kind") == 1) & (F.col("shorter") > 1)).alias("same_s"),
        F.max((F.col("kind") == 2) & (F.col("shorter") > 0)).alias("short_p"),
        F.max((F.col("kind") == 3) & (F.col("shorter") > 0)).alias("short_s"),
        F.max((F.col("kind") < 2) & (F.col("longer") > 0)).alias("longer"),
    ).where("same_p or same_s or short_p or short_s or longer")
    wanted = materialize(wanted.join(unique.select("whole", "place"), "whole"), "wanted")

    # their words, fetched from the documents of their first occurrence
    per_doc = wanted.groupBy("place.doc_id", "place.th").agg(F.collect_list(F.struct("place.line", "whole")).alias("some"))
    fetched = texts.join(per_doc, ["doc_id", "th"]).select("text", "some.line", "some.whole")
    fetched = fetched.mapInArrow(_pick_lines, "whole long, words string")
    words = materialize(wanted.join(fetched.dropDuplicates(["whole"]), "whole"), "words")

    flags = ["same_p", "same_s", "short_p", "short_s", "longer"]
    variants = words.select("whole", "words", *flags, "place.doc_id", "place.th", "place.line").mapInArrow(
        _variants, "key long, kind int, whole long, doc_id long, th long, line int")
    variants = variants.select("key", "kind", "whole", place.alias("place"))
    own = F.when(F.col("kind") == 2, F.struct("place", "whole"))
    other = F.when(F.col("kind") < 2, F.struct("place", "whole"))
    variants = materialize(variants, "variants")
    tops = variants.groupBy("key").agg(
        F.min(own).alias("own"), F.min(other).alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1")
    pairs = join_dealt_anew(variants, tops, "key").select(
        "whole", "place", F.when(F.col("kind") == 1, F.col("own")).otherwise(F.col("other")).alias("top"))
    pairs = pairs.where("top.place < place").select("whole", F.col("top.whole").alias("earlier")).distinct()
    near = (
        pairs.join(words.select("whole", "words"), "whole")
        .join(words.select(F.col("whole").alias("earlier"), F.col("words").alias("earlier_words")), "earlier")
        .select("whole", "words", "earlier_words").mapInArrow(_verify, "whole long").distinct()
    )
    near = materialize(near, "near")

    gone = unique.select("whole", "place", "last").join(near.withColumn("near", F.lit(True)), "whole", "left").where("near or place <> last")
    marked = lines.select("whole", "doc_id", "th", "line").join(gone.select("whole", "place", "near"), "whole")
    return marked.where(F.col("near") | (F.col("place") != place)).select("doc_id", "th", "line").distinct()


@F.pandas_udf(StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    def one(text, numbers):
        if text is None or numbers is None or not len(numbers):
            return text
        drop = set(numbers)
        return "\n".join(line for n, line in enumerate(text.split("\n")) if n not in drop)

    return pd.Series([one(t, g) for t, g in zip(texts, gone)], dtype=object)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, counts: bool = False, exact_words: int = 1) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; with ``counts``, also n_lines and n_dropped.

    Lines of ``exact_words`` words or more go if they equal an earlier one, those of ``min_words``
    or more also if one word inserted, deleted or replaced makes them equal. Columns of ``docs``
    named n_lines or n_dropped give way to the counts.
    """
    names, at = docs.columns, docs.columns.index("text")
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    text = F.col(f"c{at}")
    per_doc = repeated_lines(docs, min_words, exact_words).groupBy("doc_id", "th").agg(F.collect_set("line").alias("gone"))
    match = (F.col(f"c{names.index('doc_id')}").cast("long") == F.col("doc_id")) & (F.xxhash64(text) == F.col("th"))
    joined = plain.join(per_doc, match, "left")
    added = {
        "n_lines": F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    } if counts else {}
    kept = [(k, n) for k, n in enumerate(names) if n not in added]
    return joined.select(
        *[(_without(text, F.col("gone")) if k == at else F.col(f"c{k}")).alias(n) for k, n in kept],
        *[c.alias(n) for n, c in added.items()])
