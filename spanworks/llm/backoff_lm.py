"""Log-probabilities of texts under an n-gram model of the corpus, as a backoff automaton.

The states of the automaton are the contexts seen in training; an arc leads from a state
over a seen n-gram, and a failure arc leads to the state of the shorter context. Weights
come from smoothing by the lower order: with ``strength`` k,

    P(w | h) = (c(hw) + k P(w | h')) / (c(h) + k),    P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

so a seen n-gram has the weight log P(w | h), and the failure arc of h the weight
log k / (c(h) + k). A text is walked once from left to right, carrying the state: a token
follows failure arcs until the state has an arc for it, adds their weights, and moves on to
the longest seen context that ends in it.

The model is never gathered in one place. Texts are written as blocks of bounded size;
each block asks for the counts of its distinct n-grams, the requests are added up by
ranges of hashed n-grams, and the answers go to the blocks where they lie (the blocks are
written in buckets by their number, so no text is ever shuffled). Each block builds the
part of the automaton that its own texts can reach. Nothing is pruned.

Cases: null and empty texts consist of the end token alone. Rows with a null id are
scored, are not held out and are not learned from. Repeated rows are learned from and
scored once each. An empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.llm.words import crc32_rest, mix, prepare, split_words, text_pieces, word_hashes
from spanworks.workdir import work_dir

ORDER, STRENGTH, ADDED = 2, 500.0, 0.1
FOLDS = 10
#: Characters of text in a block, and n-grams per range of hashes.
BLOCK, RANGE = 12 << 20, 3_000_000
#: Texts of more tokens are walked one by one.
LONG = 2000
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
_K = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Grams:
    """The n-grams of one block.

    ``tokens`` holds a start token, the words and the end token of each text; text ``i`` is
    ``first[i]:first[i + 1]``. For order k, ``keys[k - 1]`` are the distinct hashes, sorted,
    and ``place[k - 1]`` has for each token the number of the k-gram that ends there, or -1.
    """

    tokens: np.ndarray
    first: np.ndarray
    keys: list[np.ndarray]
    place: list[np.ndarray]


def grams_of(texts: pa.Array, order: int) -> Grams:
    counts, hashed = [], []
    for _, _, data, bounds in text_pieces(texts):
        words = split_words(data, bounds)
        counts.append(words.counts)
        hashed.append(word_hashes(words))
    sizes = np.concatenate([np.zeros(0, np.int64), *counts]) + 2
    first = np.concatenate([[0], np.cumsum(sizes)])
    tokens = np.empty(first[-1], np.uint64)
    inner = np.ones(len(tokens), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    tokens[first[:-1]], tokens[first[1:] - 1] = _START, _END
    tokens[inner] = np.concatenate([np.zeros(0, np.uint64), *hashed])
    offset = np.arange(len(tokens)) - np.repeat(first[:-1], sizes)
    keys, place, hashes = [], [], tokens
    for k in range(1, order + 1):
        if k > 1:
            hashes = mix(np.concatenate([hashes[:1], hashes[:-1]]) * _K + tokens)
        # a lone start token is no n-gram; longer windows stay within their text
        valid = np.flatnonzero(offset >= max(1, k - 1))
        distinct, number = np.unique(hashes[valid], return_inverse=True)
        at = np.full(len(tokens), -1, np.int64)
        at[valid] = number
        keys.append(distinct)
        place.append(at)
    return Grams(tokens, first, keys, place)


@dataclass
class Automaton:
    """The arcs and failure arcs that the texts of one block can take.

    A state is a context of 0 to order - 1 tokens, named by its length and the number of its
    n-gram; that of length 0 is the root. ``arcs[k]`` has the weight of each (k+1)-gram, NaN where
    it was not seen, ``failures[k]`` the weight of the failure arc of the context before each
    (k+1)-gram, and ``states[k]`` whether a (k+1)-gram is a seen context, so a state.
    """

    grams: Grams
    arcs: list[np.ndarray]
    failures: list[np.ndarray]
    states: list[np.ndarray]
    unigrams: np.ndarray

    @classmethod
    def build(cls, grams: Grams, counts: list[np.ndarray], total: int, distinct: int, strength: float) -> Automaton:
        """``counts[k - 1]`` are the training counts of ``grams.keys[k - 1]``."""
        unigrams = (counts[0] + ADDED) / (total + ADDED * (distinct + 1))
        texts = counts[0][np.searchsorted(grams.keys[0], _END)] if len(grams.keys[0]) else 0
        lower, arcs, failures = unigrams, [np.log10(unigrams)], [np.zeros(len(unigrams))]
        for k in range(1, len(grams.keys)):
            at = np.flatnonzero(grams.place[k] >= 0)
            where = np.zeros(len(grams.keys[k]), np.int64)
            where[grams.place[k][at]] = at
            context = grams.place[k - 1][where - 1]  # none but after a start token, which is no n-gram
            seen = np.where(context >= 0, counts[k - 1][context], texts)
            below = lower[grams.place[k - 1][where]]
            lower = (counts[k] + strength * below) / (seen + strength)
            arcs.append(np.where(counts[k] > 0, np.log10(lower), np.nan))
            failures.append(np.log10(strength / (seen + strength)))
        return cls(grams, arcs, failures, [c > 0 for c in counts], unigrams)

    def walk(self) -> np.ndarray:
        """The log-probability of each text, by one traversal that carries the state.

        Long texts are walked one by one, the others side by side, a token of each at a time.
        """
        sizes = np.diff(self.grams.first)
        out = np.zeros(len(sizes))
        for text in np.flatnonzero(sizes > LONG).tolist():
            out[text] = self._walk_alone(text)
        short = np.flatnonzero(sizes <= LONG)
        short = short[np.argsort(-sizes[short], kind="stable")]
        out[short] = self._walk_together(short, sizes)
        return out

    def _walk_alone(self, text: int) -> float:
        place, longest = self.grams.place, len(self.arcs) - 1
        span = slice(int(self.grams.first[text]) + 1, int(self.grams.first[text + 1]))
        arcs, failures = ([x[k][place[k][span]].tolist() for k in range(longest + 1)] for x in (self.arcs, self.failures))
        states = [self.states[k][place[k][span]].tolist() for k in range(longest)]
        length, score = min(1, longest), 0.0
        for step in range(len(arcs[0])):
            while length and arcs[length][step] != arcs[length][step]:  # not a number: no such arc
                score += failures[length][step]
                length -= 1
            score += arcs[length][step]
            length = min(length + 1, longest)
            while length and not states[length - 1][step]:
                length -= 1
        return score

    def _walk_together(self, texts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of ``texts``, which come by falling size."""
        place, longest = self.grams.place, len(self.arcs) - 1
        begin, falling = self.grams.first[:-1][texts], sizes[texts]
        score, length = np.zeros(len(texts)), np.full(len(texts), min(1, longest))
        for step in range(1, int(falling[0]) if len(texts) else 0):
            live = int(np.searchsorted(-falling, -step, "left"))
            at, state, taken = begin[:live] + step, length[:live], np.zeros(live, np.int64)
            for k in range(longest, 0, -1):
                here = np.flatnonzero(state == k)
                number = place[k][at[here]]
                weight = self.arcs[k][number]
                missed = np.isnan(weight)
                score[here] += np.where(missed, self.failures[k][number], weight)
                taken[here[~missed]] = k  # the others go on from the shorter context
                state[here] = np.where(missed, k - 1, -1)
            root = np.flatnonzero(state == 0)
            score[root] += self.arcs[0][place[0][at[root]]]
            reach = np.minimum(taken + 1, longest)
            for k in range(longest, 0, -1):  # the longest state that ends in this token
                here = np.flatnonzero(reach == k)
                reach[here[~self.states[k - 1][place[k - 1][at[here]]]]] = k - 1
            length[:live] = reach
        return score


def _blocks(size: int):
    """Rows of (block, about how many tokens, ids, texts), each of about ``size`` characters."""

    def row(block: int, ids: list, texts: list) -> pa.RecordBatch:
        tokens = sum(map(len, texts)) // 6 + len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([tokens], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
             pa.array([texts], pa.list_(pa.string()))], names=["block", "tokens", "ids", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= size:
                    yield row(number, ids, texts)
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield row(number, ids, texts)

    return run


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of six bytes, or of eight where a difference needs them."""
    steps = np.diff(keys, prepend=np.uint64(0))[1:]
    width = 6 if not len(steps) or int(steps.max()) < 1 << 48 else 8
    raw = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + raw.tobytes()


def unpack_keys(packed: bytes) -> np.ndarray:
    width, head = packed[0], np.frombuffer(packed, "<u8", 1, 1)
    raw = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.cumsum(np.concatenate([head, steps.view("<u8").ravel()]), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Whole numbers as single bytes, 255 standing for the next of the larger ones, which come behind."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype("<i8").tobytes()


def unpack_counts(packed: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(packed, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(packed, "<i8", offset=n)
    return out


def _requests(order: int, ranges: int, learnt_only: bool = False):
    """(range, order, block, keys, counts) of each block: its distinct n-grams and their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                ids, texts = batch.column(1)[n].values, batch.column(2)[n].values
                grams = grams_of(texts, order)
                learn = np.repeat(crc32_rest(ids, FOLDS) > 0, np.diff(grams.first))
                rows = []
                for k, (keys, place) in enumerate(zip(grams.keys, grams.place)):
                    counts = np.bincount(place[(place >= 0) & learn], minlength=len(keys))
                    if learnt_only:
                        keys, counts = keys[counts > 0], counts[counts > 0]
                    edges = np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))
                    rows += [
                        (r, k, batch.column(0)[n].as_py(), pack_keys(keys[a:b]), pack_counts(counts[a:b]))
                        for r, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a
                    ]
                columns = list(zip(*rows)) or [[]] * 5
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names=["range", "k", "block", "keys", "counts"])

    return run


def _by_range(answer):
    """Gives ``answer`` the sorted requests of one (range, order) after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for r, k, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if (r, k) != at:
                    if rows:
                        yield answer(at, rows)
                    at, rows = (r, k), []
                rows.append(rest)
        if rows:
            yield answer(at, rows)

    return run


def _totals(rows: list[tuple]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The keys of each request, the number of each key, and the total count by number."""
    keys = [unpack_keys(r[1]) for r in rows]
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([unpack_counts(r[2], len(k)) for r, k in zip(rows, keys)])
    return keys, number, np.bincount(number, weights=counts).astype(np.int64)


def _answer(at: tuple[int, int], rows: list[tuple]) -> pa.RecordBatch:
    keys, number, totals = _totals(rows)
    edges = np.cumsum([0, *map(len, keys)])
    back = [pack_counts(totals[number[a:b]]) for a, b in zip(edges[:-1], edges[1:])]
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([at[1]] * n, pa.int32()), pa.array([at[0]] * n, pa.int32()),
         pa.array([len(k) for k in keys], pa.int32()), pa.array(back, pa.binary())], names=["block", "k", "range", "n", "totals"])


def _sums(at: tuple[int, int], rows: list[tuple]) -> pa.RecordBatch:
    """(how many known tokens, their total count) of a range."""
    _, _, totals = _totals(rows)
    return pa.RecordBatch.from_arrays([pa.array([int((totals > 0).sum())]), pa.array([int(totals.sum())])], names=["known", "added"])


def _scores(order: int, total: int, distinct: int, strength: float):
    """Scores of the texts of each block; its answers come with it, in any order."""

    def score(ids: pa.Array, texts: pa.Array, answers: list[dict]) -> pa.RecordBatch:
        grams = grams_of(texts, order)
        parts: list[list[np.ndarray]] = [[] for _ in range(order)]
        for a in sorted(answers, key=lambda a: (a["k"], a["range"])):
            parts[a["k"]].append(unpack_counts(a["totals"], a["n"]))
        counts = [np.concatenate([np.zeros(0, np.int64), *p]) for p in parts]
        automaton = Automaton.build(grams, counts, total, distinct, strength)
        start, real = grams.first[:-1], grams.place[0] >= 0
        base = np.where(real, np.log10(automaton.unigrams)[grams.place[0]], 0)
        known = real & (counts[0][grams.place[0]] > 0)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(crc32_rest(ids, FOLDS) == 0), pa.array(np.diff(grams.first) - 1),
             pa.array(np.add.reduceat(known.astype(np.int64), start)), pa.array(np.full(len(ids), total, np.int64)),
             pa.array(np.add.reduceat(base, start)), pa.array(automaton.walk())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                yield score(batch.column(0)[n].values, batch.column(1)[n].values, batch.column(2)[n].as_py())

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _in_buckets(df: DataFrame, label: str, key: str) -> DataFrame:
    """``df`` written in buckets by ``key``, as many as shuffles have partitions, so that a join by it moves the other side alone.

    The table's name is dropped at once; its files are outside the catalog and stay.
    """
    spark, name = df.sparkSession, f"spanworks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", work_dir(spark, label)).bucketBy(buckets, key).saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def score(docs: DataFrame, order: int = ORDER, strength: float = STRENGTH, block: int = BLOCK, range_size: int = RANGE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...) with the columns of ``RESULT``.

    Learns from rows whose crc32(doc_id as text) modulo ``FOLDS`` is not 0. ``score`` is the
    log10 probability of the text; ``base_score`` that of its tokens without context.
    """
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _in_buckets(
        texts.mapInArrow(_blocks(block), "block long, tokens long, ids array<long>, texts array<string>"), "blocks", "block")
    tokens = blocks.agg(F.sum("tokens")).first()[0]
    if not tokens:
        return spark.createDataFrame([], RESULT)

    def requests(order: int, learnt_only: bool) -> DataFrame:
        ranges = max(1, -(-tokens * order // range_size))
        asked = blocks.select("block", "ids", "texts").mapInArrow(
            _requests(order, ranges, learnt_only), "range int, k int, block long, keys binary, counts binary")
        return asked.repartition("range", "k").sortWithinPartitions("range", "k")

    sums = requests(1, True).mapInArrow(_by_range(_sums), "known long, added long").agg(F.sum("known"), F.sum("added")).first()
    answers = requests(order, False).mapInArrow(_by_range(_answer), "block long, k int, range int, n int, totals binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("k", "range", "n", "totals")).alias("answers"))
    return blocks.join(answers, "block").select("ids", "texts", "answers").mapInArrow(
        _scores(order, int(sums[1] or 0), int(sums[0] or 0), strength), RESULT)
