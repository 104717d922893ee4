"""Licences of files: notices by TF-IDF cosine to templates, the rest from directories above.

Every line of a file and every run of up to ``WINDOW`` lines, without comment marks, is a
possible header, and its whole text a possible licence file, held against whole licence
texts too. All become sparse vectors of word counts times inverse document frequency, where the
frequencies of the templates' words are counted over all lines of the corpus, and are
compared with the templates. A word that no template has counts as a dimension of its own
at every place, with the weight of a word never seen.

A match counts only if the text names the same licence, variant (Lesser, Affero, ShareAlike,
NoDerivatives, ...) and version as the template; whole texts must bear their title or first
phrase. BSD notices, which begin alike, are told apart by the clauses below them.

A file's own licence is that of the whole text it holds, or else of its best lines; own_similarity
is the greatest to any template, of refused ones too. A file is a licence file if it is named
like one or if its whole text is like a template; it speaks for its directory (the most
alike one, then the one with the least path). A file without a licence of its own takes
that of the nearest directory at or above its own. Directories, not files, are joined with
the directories above them, so the join is small whatever a directory holds.

Cases: null and empty texts have no licence of their own and may inherit one. A null path
has no directory. Among equally similar templates the first in order counts. Rows that
repeat a path each get a result. The top directory, with or without a slash, is '' and above
all others. An empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.llm.graph import join_dealt_anew
from spanworks.llm.licence_notices import TEMPLATES, TEXTS, agree, bsd_label, terms, text_label
from spanworks.llm.line_labels import split_lines
from spanworks.llm.words import prepare, range_hashes, split_words, text_pieces
from spanworks.workdir import materialize

SIMILARITY = 0.7
#: Most lines that a wrapped notice may take.
WINDOW = 8
#: Lines compared at once.
BLOCK = 4096
LICENCE_NAMES = ("license", "licence", "copying", "notice", "unlicense")

_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def term_hashes(words) -> np.ndarray:
    """Hashes of the words without signs at their ends."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        more = (end - start > 1) & _SIGN[words.data[np.maximum(end - 1, 0)]]
        end[more] -= 1
        more = (end - start > 1) & _SIGN[words.data[np.minimum(start, len(words.data) - 1)]]
        start[more] += 1
    return range_hashes(words.data, start, end)


def _words(texts: list[str]):
    column = pa.array(texts, pa.string())
    _, _, data, bounds = next(text_pieces(column, 1 << 30))
    return split_words(data, bounds)


class Templates:
    """Vocabulary, term counts and weights of the templates."""

    def __init__(self, notices: tuple[tuple[str, str], ...]):
        words = _words([text for _, text in notices])
        hashes = term_hashes(words)
        self.names, self.texts = [name for name, _ in notices], [text for _, text in notices]
        self.terms = np.unique(hashes)
        owner = np.repeat(np.arange(len(notices)), words.counts)
        self.counts = np.zeros((len(notices), len(self.terms)))
        np.add.at(self.counts, (owner, np.searchsorted(self.terms, hashes)), 1)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The term of each hash, or -1."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def stretches(self, numbers: np.ndarray, edges: np.ndarray, weight: np.ndarray, unseen: float) -> "Stretches":
        """The stretches ``edges[i]:edges[i + 1]`` of words, as vectors."""
        n, width = len(edges) - 1, len(self.terms)
        owner = np.repeat(np.arange(n), np.diff(edges))
        known = numbers >= 0
        cells = np.bincount(owner[known] * width + numbers[known], minlength=n * width).reshape(n, width) * weight
        other = np.diff(np.concatenate([[0], np.cumsum(numbers == -1)])[edges]) * unseen**2
        rows = self.counts * weight
        return Stretches(cells, other, cells @ rows.T, np.sqrt((rows * rows).sum(1)))


class Stretches:
    """Vectors of stretches of words (cells of known terms, squares of the others) and their products with the templates."""

    def __init__(self, cells: np.ndarray, other: np.ndarray, dots: np.ndarray, lengths: np.ndarray):
        self.cells, self.other, self.dots, self.lengths = cells, other, dots, lengths
        self.square = (cells * cells).sum(1)

    def cosines(self) -> np.ndarray:
        """(stretch, template) similarities."""
        return self.dots / np.maximum(np.sqrt(self.square + self.other)[:, None] * self.lengths[None, :], 1e-12)

    def runs(self, starts: int, end: np.ndarray, cutoff: float, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, first stretch, similarities) of the runs of k = 2..``size`` stretches, before ``end`` of the first, that may reach ``cutoff``.

        They begin at one of the first ``starts`` stretches. Cells are never negative, so a run is at least as long as its stretches together: no run that reaches ``cutoff`` is left out.
        """
        dots, square, other = (np.concatenate([np.zeros_like(x[:1]), np.cumsum(x, 0)]) for x in (self.dots, self.square, self.other))
        for k in range(2, size + 1):
            at = np.flatnonzero(np.arange(starts) + k <= end[:starts])
            least = np.sqrt(np.maximum(square[at + k] - square[at] + other[at + k] - other[at], 0))
            at = at[((dots[at + k] - dots[at]) >= (cutoff - 1e-6) * least[:, None] * self.lengths[None, :]).any(1)]
            for few in np.array_split(at, len(at) // 4096 + 1) if len(at) else ():
                cells = sum(self.cells[few + j] for j in range(k))
                length = np.sqrt((cells * cells).sum(1) + sum(self.other[few + j] for j in range(k)))
                yield k, few, sum(self.dots[few + j] for j in range(k)) / np.maximum(length[:, None] * self.lengths[None, :], 1e-12)


def _pieces(column: pa.Array):
    """(first row, rows, words, lines, term hashes, words that are comment marks) of pieces of a text column."""
    for low, high, data, bounds in text_pieces(column):
        words = split_words(data, bounds)
        yield low, high - low, words, split_lines(words), term_hashes(words), _marks(words)


def _marks(words) -> np.ndarray:
    """Words of one to three signs alone, as lines of comments begin with."""
    size, last = words.end - words.start, max(len(words.data) - 1, 0)
    out = size <= 3
    for k in range(3):
        out &= (size <= k) | _SIGN[words.data[np.minimum(words.start + k, last)]] if len(words.data) else out
    return out


def _frequencies(sets: tuple[Templates, ...]):
    """(set, term, lines that hold it), and the number of lines as term -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, lines_seen = [np.zeros(len(t.terms), np.int64) for t in sets], 0
        for batch in batches:
            for _, _, _, lines, hashes, _ in _pieces(batch.column(0)):
                n = len(lines.edges) - 1
                owner = np.repeat(np.arange(n), np.diff(lines.edges))
                for total, t in zip(sums, sets):
                    numbers, width = t.numbers(hashes), len(t.terms)
                    known = numbers >= 0
                    total += np.bincount(np.unique(owner[known] * width + numbers[known]) % width, minlength=width)
                lines_seen += n
        for k, total in enumerate(sums):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(total) + 1, k, np.int32)), pa.array(np.arange(-1, len(total), dtype=np.int32)),
                 pa.array(np.concatenate([[lines_seen], total]))], names=["part", "term", "n"])

    return run


def _scan(notices: Templates, texts: Templates, weight, text_weight, similarity: float, text: int):
    """Adds the licence and the similarity of the best lines, the greatest similarity of any, and those of the whole text."""
    wanted = [terms(t) for t in notices.texts]
    like = {name: k for k, name in enumerate(texts.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed: dict[str, np.ndarray] = {}

        def fits(stretch: str) -> np.ndarray:
            if stretch not in allowed:
                if len(allowed) > 10_000:
                    allowed.clear()
                found = terms(stretch)
                allowed[stretch] = np.array([agree(found, w) for w in wanted])
            return allowed[stretch]

        def accepted(words, start: int, end: int, cosines: np.ndarray) -> tuple[float, int] | None:
            """The best template that agrees with the bytes of a stretch in its terms."""
            stretch = bytes(words.data[start:end]).decode("utf-8", "replace")
            sims = np.where(fits(stretch) & (cosines >= similarity), np.round(cosines, 9), -1.0)
            at = int(sims.argmax())
            return (float(cosines[at]), at) if sims[at] >= 0 else None

        def name(at: int, words, row: int) -> str:
            label = notices.names[at]
            if label.startswith("BSD") and "edistribution" in notices.texts[at]:
                return bsd_label(bytes(words.data[words.bounds[row] : words.bounds[row + 1]]).decode("utf-8", "replace"))
            return label

        for batch in batches:
            size = len(batch)
            line_name, line_sim, any_sim = np.full(size, None, object), np.zeros(size), np.zeros(size)
            whole_name, whole_sim, full = np.full(size, None, object), np.zeros(size), np.zeros(size, bool)
            for low, n, words, lines, hashes, marks in _pieces(batch.column(text)):
                numbers = np.where(marks, -2, notices.numbers(hashes))
                owner = np.repeat(np.arange(n), np.diff(lines.first))
                end = lines.first[owner + 1]
                best: dict[int, tuple[float, int, int, int]] = {}
                for a in range(0, len(owner), BLOCK):
                    starts = min(BLOCK, len(owner) - a)
                    edges = lines.edges[a : a + starts + WINDOW]  # the lines of the block, and those that its runs reach into
                    block = notices.stretches(numbers[edges[0] : edges[-1]], edges - edges[0], *weight)
                    cosines = block.cosines()[:starts]
                    for k, at, cosines in ((1, np.arange(starts), cosines), *block.runs(starts, end[a:] - a, similarity, WINDOW)):
                        top = cosines.max(1, initial=0)
                        np.maximum.at(any_sim, low + owner[a + at], top)
                        for i in np.flatnonzero(top >= similarity):
                            first = a + int(at[i])
                            row = int(owner[first])
                            if row in best and round(top[i], 9) < -best[row][0]:
                                continue
                            if hit := accepted(words, int(lines.start[first]), int(lines.end[first + k - 1]), cosines[i]):
                                best[row] = min(best.get(row, (1.0,)), (-round(hit[0], 9), k, first, hit[1]))
                for row, (sim, _, _, at) in best.items():
                    line_name[low + row], line_sim[low + row] = name(at, words, row), -sim

                for a in range(0, n, 256):
                    b = min(a + 256, n)
                    some = slice(words.first[a], words.first[b])
                    edges = words.first[a : b + 1] - words.first[a]
                    short = notices.stretches(numbers[some], edges, *weight).cosines()
                    long = texts.stretches(np.where(marks[some], -2, texts.numbers(hashes[some])), edges, *text_weight).cosines()
                    hopes = (short.max(1, initial=0) >= similarity) | (long.max(1, initial=0) >= similarity)
                    for i in np.flatnonzero(hopes):
                        start, end = int(words.bounds[a + i]), int(words.bounds[a + i + 1])
                        label = text_label(bytes(words.data[start:end]).decode("utf-8", "replace")) if long[i].max() >= similarity else None
                        if label and label[1] in like and long[i, like[label[1]]] >= similarity:
                            whole_name[low + a + i], whole_sim[low + a + i], full[low + a + i] = label[0], long[i, like[label[1]]], True
                        elif hit := accepted(words, start, end, short[i]):
                            whole_name[low + a + i], whole_sim[low + a + i] = name(hit[1], words, a + int(i)), hit[0]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(line_name, pa.string()), pa.array(line_sim), pa.array(any_sim),
                 pa.array(whole_name, pa.string()), pa.array(whole_sim), pa.array(full)],
                names=[*batch.schema.names, "line_licence", "line_similarity", "any_similarity", "whole_licence", "whole_similarity", "full"])

    return run


def weights(texts: DataFrame, sets: tuple[Templates, ...]) -> list[tuple[np.ndarray, float]]:
    """Per set, the inverse document frequencies of its terms over all lines, and that of a term never seen."""
    counts = texts.mapInArrow(_frequencies(sets), "part int, term int, n long").groupBy("part", "term").agg(F.sum("n").alias("n")).collect()
    lines = next((r.n for r in counts if r.term < 0), 0)
    seen = [np.zeros(len(t.terms)) for t in sets]
    for r in counts:
        if r.term >= 0:
            seen[r.part][r.term] = r.n
    return [(np.log((1 + lines) / (1 + s)) + 1, float(np.log(1 + lines) + 1)) for s in seen]


def scan(files: DataFrame, notices=TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """``files`` (path, text, ...) without the text, with the columns

    own_licence, own_similarity, licence, similarity and inherited_from (a directory, or null).
    Columns of ``files`` with one of these names give way.
    """
    prepare(files.sparkSession)
    notices, texts = Templates(notices), Templates(TEXTS)
    weight, text_weight = weights(files.select("text"), (notices, texts))
    plain = files.toDF(*[f"c{k}" for k in range(len(files.columns))])
    path, text = (files.columns.index(c) for c in ("path", "text"))
    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes)
    scanned = plain.mapInArrow(
        _scan(notices, texts, weight, text_weight, similarity, text),
        schema + ", line_licence string, line_similarity double, any_similarity double, whole_licence string, whole_similarity double, full boolean",
    ).drop(f"c{text}")
    directory = F.regexp_extract(F.col(f"c{path}"), "^(.*)/[^/]*$", 1)
    own, whole = F.col("line_licence").isNotNull(), F.col("whole_licence").isNotNull()
    name = F.lower(F.regexp_extract(F.col(f"c{path}"), r"([^/.]*)[^/]*$", 1))
    alike = F.greatest("any_similarity", F.when(F.col("full"), F.col("whole_similarity")).otherwise(0.0))
    scanned = materialize(scanned.select(
        "*", directory.alias("_dir"), F.xxhash64(directory).alias("_key"),
        F.when(F.col("full"), F.col("whole_licence")).otherwise(F.col("line_licence")).alias("own_licence"),
        F.when(alike >= similarity, alike).alias("own_similarity"),
        F.when(F.col("full"), F.col("whole_similarity")).otherwise(F.col("line_similarity")).alias("_own"),
        F.when(whole, F.col("whole_licence")).when(own & name.isin(*LICENCE_NAMES), F.col("line_licence")).alias("_speaks"),
        F.greatest("line_similarity", "whole_similarity").alias("_alike"),
    ), "scanned")

    speaking = scanned.where(F.col("_speaks").isNotNull() & F.col("_dir").isNotNull()).groupBy("_dir").agg(
        F.min(F.struct((-F.col("_alike")).alias("alike"), F.col(f"c{path}").alias("path"), F.col("_speaks").alias("licence"))).alias("best"))
    parts = F.split("_dir", "/")
    above = scanned.where(F.col("_dir").isNotNull()).select("_dir", "_key").distinct().select(
        "_dir", "_key", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn(
        "up", F.array_join(F.slice(parts, F.lit(1), F.col("depth")), "/"))
    inherited = (
        above.join(speaking.withColumnRenamed("_dir", "up"), "up").groupBy("_dir", "_key")
        .agg(F.max(F.struct("depth", "up", "best")).alias("from"))
        .select("_key", F.col("_dir").alias("_of"), F.col("from.best.licence").alias("_licence"), (-F.col("from.best.alike")).alias("_sim"), F.col("from.up").alias("_from"))
    )
    joined = join_dealt_anew(scanned, inherited, "_key", "left")
    mine = F.col("own_licence").isNotNull()
    added = ("own_licence", "own_similarity", "licence", "similarity", "inherited_from")
    kept, others = zip(*[(f"c{k}", c) for k, c in enumerate(files.columns) if k != text and c not in added])
    return joined.select(
        *[F.col(k).alias(c) for k, c in zip(kept, others)], "own_licence", "own_similarity",
        F.coalesce("own_licence", "_licence").alias("licence"), F.when(mine, F.col("_own")).otherwise(F.col("_sim")).alias("similarity"),
        F.when(~mine, F.col("_from")).alias("inherited_from"))
