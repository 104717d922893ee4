"""Quality rules by labelling lines: a linear-chain conditional random field.

Every line with a word is content or boilerplate. A two-state linear-chain CRF scores the
surface features of a line and the step from the line before; Viterbi decoding labels the
lines of a text, and the share of words in content lines decides whether the text stays.
Base rules reject texts that are short or repeat themselves, whatever the lines say.

The CRF is fitted on the driver with numpy by maximum likelihood, on at most ``SAMPLE``
labelled documents (those with the least hash of their id; of a longer one a run
of ``SAMPLE_LINES`` lines, its place chosen by a hash of the id). Lines of documents of quality are taken for
content, but those that stand in ``REPEATED`` or more of the sampled documents for boilerplate, as are all lines
of other documents; so steps from content to boilerplate and back are learnt from. Decoding and rules
are one pass without a shuffle.

Cases: null and empty texts have zero counts and fail the base rules, as has any text
without words. Without labelled documents of both kinds every line is content. Labels
that are null are left out; of several labels of a document the least counts. Repeated
rows each get a result. Extra columns are ignored, or pass through ``keep_content``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.llm.features import NAMES, SYMBOL, counter, stretch_features
from spanworks.llm.quality_model import adam, labelled_sample
from spanworks.llm.words import Words, distinct, mix, prepare, range_hashes, split_words, text_pieces, window_hashes, word_hashes

SAMPLE, SAMPLE_LINES = 2000, 64
#: Documents of the sample in which a line stands that is taken for boilerplate wherever it stands.
REPEATED = 10
#: Words needed, most repeated words in 100, window of words, least content words in 100.
MIN_WORDS, MAX_REPEATED, WINDOW, MIN_CONTENT = 50, 50, 3, 50
_STEPS, _RATE, _DECAY = 120, 0.08, 1e-4
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Lines:
    """Lines with a word: bytes ``start:end``, word bounds, and the bounds of each text's lines."""

    start: np.ndarray
    end: np.ndarray
    edges: np.ndarray
    first: np.ndarray


def split_lines(words: Words) -> Lines:
    data, bounds = words.data, words.bounds
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([bounds[:-1], breaks + 1]))
    end = np.sort(np.concatenate([bounds[1:], breaks]))
    at = np.searchsorted(words.start, start)
    some = np.searchsorted(words.start, end) > at
    start, end, at = start[some], end[some], at[some]
    return Lines(start, end, np.concatenate([at, [len(words.start)]]), np.searchsorted(start, bounds))


def repeated_words(words: Words, size: int = WINDOW) -> np.ndarray:
    """Per text, the words inside windows of ``size`` words that occur twice or more in it."""
    n = len(words.start)
    covered = np.zeros(n + 1, np.int32)
    if n >= size:
        text = np.repeat(np.arange(len(words.first) - 1), words.counts)
        keys = mix(window_hashes(word_hashes(words), size) + mix(text[: n - size + 1].astype(np.uint64) + np.uint64(1)))
        whole = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
        order = whole[np.argsort(keys[whole], kind="stable")]
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = order[twice]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + size, -1)
    sums = counter(np.cumsum(covered[:-1]) > 0)
    return np.diff(sums[words.first])


def repeated_lines(words: Words, lines: Lines) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line."""
    text = np.repeat(np.arange(len(lines.first) - 1), np.diff(lines.first))
    keys = mix(range_hashes(words.data, lines.start, lines.end) + mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:][keys[order[1:]] == keys[order[:-1]]]] = True
    return np.diff(counter(again)[lines.first])


def padded(rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each text side by side: (text, place, ...) filled with zeros, and the lengths."""
    sizes = np.diff(first)
    out = np.zeros((len(sizes), max(int(sizes.max(initial=0)), 1), *rows.shape[1:]))
    text = np.repeat(np.arange(len(sizes)), sizes)
    out[text, np.arange(len(text)) - first[:-1][text]] = rows
    return out, sizes


@dataclass
class Chain:
    """State 1 is content. A line's score is a line of its features; steps have scores too."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        """(line, state) scores."""
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        score = x @ self.parts["weight"] + self.parts["bias"][0]
        return np.stack([np.zeros(len(rows)), score], 1)

    def decode(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best state of each line, by Viterbi over each text; ties go to content.

        Texts are walked side by side, a line of each at a time, so memory grows with the lines
        alone, however long one text is beside the others.
        """
        score, sizes, step = self.emissions(rows), np.diff(first), self.parts["step"]
        order = np.argsort(-sizes, kind="stable")
        falling, begin = sizes[order], first[:-1][order]
        live = np.searchsorted(-falling, -np.arange(int(sizes.max(initial=0))), "left").tolist()  # texts with a k-th line
        back, out = np.zeros((len(rows), 2), np.int8), np.zeros(len(rows), np.int8)
        best = score[begin[: live[0]]] + self.parts["start"] if live else np.zeros((0, 2))
        for k, n in enumerate(live[1:], 1):
            at = begin[:n] + k
            options = best[:n, :, None] + step
            back[at] = options[:, 1] >= options[:, 0]
            best[:n] = np.maximum(options[:, 0], options[:, 1]) + score[at]
        state = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for k in range(len(live) - 1, -1, -1):
            n = live[k]
            at = begin[:n] + k
            out[at] = state[:n]
            state[:n] = back[at, state[:n]]
        return out

    def gradients(self, rows: np.ndarray, first: np.ndarray, states: np.ndarray) -> dict[str, np.ndarray]:
        """Of the negative mean log-likelihood of the states, by the forward-backward sums."""
        x = np.clip((rows - self.mean) / self.scale, -8, 8)
        score, sizes = padded(self.emissions(rows), first)
        step, n, width = self.parts["step"], len(sizes), score.shape[1]
        ahead, behind = np.full(score.shape, -np.inf), np.zeros(score.shape)
        ahead[:, 0] = score[:, 0] + self.parts["start"]
        for k in range(1, width):
            ahead[:, k] = np.logaddexp.reduce(ahead[:, k - 1][:, :, None] + step, 1) + score[:, k]
        for k in range(width - 2, -1, -1):
            later = np.logaddexp.reduce(step + (score[:, k + 1] + behind[:, k + 1])[:, None, :], 2)
            behind[:, k] = np.where((sizes > k + 1)[:, None], later, 0)
        end = ahead[np.arange(n), sizes - 1]
        total = np.logaddexp.reduce(end, 1)
        share = np.exp(ahead + behind - total[:, None, None])
        truth, _ = padded(states, first)
        text = np.repeat(np.arange(n), sizes)
        place = np.arange(len(text)) - first[:-1][text]
        residual = (share[text, place, 1] - states) / n
        steps = np.zeros((2, 2))
        for k in range(1, width):
            on = sizes > k
            joint = ahead[on, k - 1][:, :, None] + step + (score[on, k] + behind[on, k])[:, None, :]
            steps += np.exp(joint - total[on][:, None, None]).sum(0)
            np.subtract.at(steps, (truth[on, k - 1].astype(int), truth[on, k].astype(int)), 1)
        start = share[:, 0].sum(0) - np.bincount(truth[:, 0].astype(int), minlength=2)
        return {"weight": x.T @ residual, "bias": np.array([residual.sum()]), "step": steps / n, "start": start / n}


def weak_labels(hashes: list[np.ndarray], labels: np.ndarray, repeated: int = REPEATED) -> list[np.ndarray]:
    """The state of each line of each text: the text's label, but 0 where ``repeated`` texts have the line."""
    every = [distinct(h) for h in hashes]
    lines, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]), return_counts=True)
    often = lines[n >= repeated]
    return [np.where(np.isin(h, often), 0.0, float(label)) for h, label in zip(hashes, labels)]


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, states: list[np.ndarray] | None = None) -> Chain | None:
    """The CRF of labelled texts, given the features of their lines and, if not the texts' labels, their states; None unless both labels occur."""
    states = states or [np.full(len(s), float(y)) for s, y in zip(sets, labels)]
    states = [s for s, x in zip(states, sets) if len(x)]
    known = [k for k, s in enumerate(sets) if len(s)]
    sets, labels = [sets[k] for k in known], labels[known]
    if len(set(labels.tolist())) < 2:
        return None
    rows = np.concatenate(sets).astype(np.float64)
    sizes = np.array([len(s) for s in sets])
    first, states = np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(states)
    parts = {"weight": np.zeros(rows.shape[1]), "bias": np.zeros(1), "step": np.zeros((2, 2)), "start": np.zeros(2)}
    chain = Chain(rows.mean(0), rows.std(0) + 1e-3, parts)
    adam(parts, lambda: chain.gradients(rows, first, states), _STEPS, _RATE, _DECAY)
    return chain


def place_of_run(doc_id: int, lines: int) -> int:
    """Where the ``SAMPLE_LINES`` lines of a text that are learnt from begin, by a hash of its id: any place, the last lines included."""
    return zlib.crc32(str(doc_id).encode()) % (max(lines - SAMPLE_LINES, 0) + 1)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, hashes = [], []
        for low, _, data, bounds in text_pieces(batch.column(2)):
            words = split_words(data, bounds, lower=False)
            lines = split_lines(words)
            rows, keys = stretch_features(words, lines.edges), range_hashes(words.data, lines.start, lines.end)
            for n, (a, b) in enumerate(zip(lines.first[:-1], lines.first[1:]), low):
                a += place_of_run(batch.column(0)[n].as_py(), int(b - a))
                cells.append(rows[a : min(a + SAMPLE_LINES, b)].astype("<f4").tobytes())
                hashes.append(keys[a : min(a + SAMPLE_LINES, b)].astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(cells, pa.binary()), pa.array(hashes, pa.binary())], names=["doc_id", "quality", "lines", "hashes"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain | None:
    prepare(docs.sparkSession)
    rows = labelled_sample(docs, labels, sample).mapInArrow(_line_rows, "doc_id long, quality int, lines binary, hashes binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.lines)))
    sets = [np.frombuffer(r.lines, "<f4").reshape(-1, len(NAMES)) for r in rows]
    labels = np.array([r.quality for r in rows])
    return fit_chain(sets, labels, weak_labels([np.frombuffer(r.hashes, "<u8") for r in rows], labels))


def judge(column: pa.Array, chain: Chain | None) -> tuple[np.ndarray, np.ndarray]:
    """The counts of each text, one column per name in ``COUNTS``, and its words in content lines."""
    counts, content = [], []
    for low, high, data, bounds in text_pieces(column):
        words = split_words(data, bounds, lower=False)
        lines = split_lines(words)
        heads = counter((data & 0xC0) != 0x80)
        chars = np.concatenate([[0], np.cumsum(heads[words.end] - heads[words.start])])[words.first]
        symbols = counter(SYMBOL[data])[bounds]
        counts.append(np.stack(
            [words.counts, np.diff(chars), np.diff(symbols), repeated_lines(words, lines), repeated_words(words)], 1))
        if chain is None:
            content.append(words.counts)
            continue
        state = chain.decode(stretch_features(words, lines.edges), lines.first)
        good = np.concatenate([[0], np.cumsum(np.diff(lines.edges) * state)])
        content.append(np.diff(good[lines.first]))
    return np.concatenate(counts).astype(np.int64), np.concatenate(content).astype(np.int64)


def _judged(chain: Chain | None, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            counts, content = judge(batch.column(text), chain)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])
            kept = ~failed & (100 * content >= MIN_CONTENT * counts[:, 0])
            columns = [*batch.columns, *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(content), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *COUNTS, "base_failed", "content_words", "kept"])

    return run


_ADDED = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, content_words long, kept boolean"


def verdicts(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """(doc_id, counts, base_failed, content_words, kept) of each row."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_judged(chain, 1), "doc_id long, text string, " + _ADDED).drop("text")


def keep_content(docs: DataFrame, chain: Chain | None) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged."""
    prepare(docs.sparkSession)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", " + _ADDED
    out = plain.mapInArrow(_judged(chain, docs.columns.index("text")), schema).where("kept")
    return out.select(*plain.columns).toDF(*docs.columns)
