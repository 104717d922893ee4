"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded; a gated
attention, learned from the labels of whole documents, weights the passages; the weighted
representation gives the score. Scoring is one pass without a shuffle.

The model is fitted on the driver with numpy, on at most ``SAMPLE`` labelled documents
outside the held-out fold (those with the least hash of their id; of a longer document at
most ``SAMPLE_PASSAGES`` evenly spaced passages). Inputs are the surface features of
passages; labels, language, source and id are no inputs.

Cases: null and empty texts and texts without words are one passage of zero features, so
that they have a score too. Without labelled documents of both kinds every score is 0.5.
Rows with a null id are scored and are not held out. Labels that are null are left out;
of several labels of a document the least counts. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.llm.features import NAMES, stretch_features
from spanworks.llm.words import prepare, split_words, text_pieces, with_fold

PASSAGE = 64
SAMPLE, SAMPLE_PASSAGES = 3000, 64
FOLDS = 5
#: Scores from here on are taken for quality.
THRESHOLD = 0.3
_HIDDEN, _GATE, _STEPS, _RATE, _DECAY = 16, 8, 200, 0.03, 1e-4


def passages(words) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds of all passages of a piece, and the bounds of each text's passages."""
    counts = -(-words.counts // PASSAGE)
    first = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(counts)), counts)
    begins = words.first[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * PASSAGE
    return np.concatenate([begins, words.first[-1:]]).astype(np.int64), first


def bags(column: pa.Array) -> Iterator[np.ndarray]:
    """The passage features of each text; one row of zeros for a text without words."""
    for _, _, data, bounds in text_pieces(column):
        words = split_words(data, bounds, lower=False)
        edges, first = passages(words)
        rows = stretch_features(words, edges)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            yield rows[a:b] if b > a else np.zeros((1, len(NAMES)), np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Attention:
    """Encoder, gated attention and output layer; features are first centred and scaled."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def _forward(self, rows: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.parts, np.clip((rows - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ p["encode"] + p["shift"])
        t, s = np.tanh(h @ p["value"]), _sigmoid(h @ p["gate"])
        e = (t * s) @ p["weight"]
        top = np.repeat(np.maximum.reduceat(e, starts), sizes)
        a = np.exp(e - top)
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ p["out"] + p["bias"][0])}

    def scores(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self._forward(rows.astype(np.float64), np.cumsum(sizes) - sizes, sizes)["score"]

    def gradients(self, rows: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy."""
        p, starts = self.parts, np.cumsum(sizes) - sizes
        f = self._forward(rows, starts, sizes)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        r = (f["score"] - labels) / len(labels)
        dz = np.repeat(r[:, None] * p["out"], sizes, 0)
        da = (h * dz).sum(1)
        de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
        dg = de[:, None] * p["weight"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ p["value"].T + ds @ p["gate"].T) * (1 - h * h)
        return {
            "encode": f["x"].T @ dh, "shift": dh.sum(0), "value": h.T @ dt, "gate": h.T @ ds,
            "weight": (t * s).T @ de, "out": f["z"].T @ r, "bias": np.array([r.sum()]),
        }


def adam(parts: dict[str, np.ndarray], gradients, steps: int, rate: float, decay: float) -> None:
    """Changes ``parts`` in place by ``steps`` steps of Adam."""
    first = {k: np.zeros_like(v) for k, v in parts.items()}
    second = {k: np.zeros_like(v) for k, v in parts.items()}
    for step in range(1, steps + 1):
        for k, g in gradients().items():
            g = g + decay * parts[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            parts[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)


def fit_attention(sample: list[np.ndarray], labels: np.ndarray) -> Attention | None:
    """The model of some bags; None unless both labels occur."""
    if len(set(labels.tolist())) < 2:
        return None
    sizes = np.array([len(b) for b in sample])
    rows = np.concatenate(sample).astype(np.float64)
    rng, width = np.random.default_rng(11), rows.shape[1]
    parts = {
        "encode": rng.normal(0, 0.3, (width, _HIDDEN)), "shift": np.zeros(_HIDDEN),
        "value": rng.normal(0, 0.3, (_HIDDEN, _GATE)), "gate": rng.normal(0, 0.3, (_HIDDEN, _GATE)),
        "weight": rng.normal(0, 0.3, _GATE), "out": rng.normal(0, 0.3, _HIDDEN), "bias": np.zeros(1),
    }
    model = Attention(rows.mean(0), rows.std(0) + 1e-3, parts)
    adam(parts, lambda: model.gradients(rows, sizes, labels), _STEPS, _RATE, _DECAY)
    return model


def _bag_rows(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for bag in bags(batch.column(2)):
                if len(bag) > limit:
                    bag = bag[np.linspace(0, len(bag) - 1, limit).astype(int)]
                cells.append(bag.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cells, pa.binary())], names=["doc_id", "quality", "bag"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int, folds: int = 0) -> DataFrame:
    """(doc_id, quality, text) of at most ``size`` labelled documents, without fold 0 of ``folds`` if given."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality is not null")
    if folds:
        known = with_fold(known, folds).where("fold <> 0").drop("fold")
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Attention | None:
    """Learns from labelled documents whose crc32(doc_id as text) modulo ``FOLDS`` is not 0."""
    prepare(docs.sparkSession)
    rows = labelled_sample(docs, labels, sample, FOLDS).mapInArrow(
        _bag_rows(SAMPLE_PASSAGES), "doc_id long, quality int, bag binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.bag)))
    sets = [np.frombuffer(r.bag, "<f4").reshape(-1, len(NAMES)) for r in rows]
    return fit_attention(sets, np.array([r.quality for r in rows], float)) if rows else None


def _score(model: Attention | None, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.full(len(batch), 0.5)
            if model is not None and len(batch):
                sets = list(bags(batch.column(text)))
                scores = model.scores(np.concatenate(sets), np.array([len(b) for b in sets]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def _scored(docs: DataFrame, model: Attention | None, text: int) -> DataFrame:
    """``docs`` with ``score`` after its columns; ``text`` is the place of the texts."""
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double"
    return docs.mapInArrow(_score(model, text), schema)


def predictions(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``."""
    prepare(docs.sparkSession)
    scored = _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, sample), 1)
    return with_fold(scored, FOLDS).select(
        "doc_id", F.coalesce(F.col("fold") == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: Attention | None) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, columns unchanged."""
    prepare(docs.sparkSession)
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return _scored(plain, model, docs.columns.index("text")).where(F.col("score") >= THRESHOLD).select(*plain.columns).toDF(*docs.columns)
