"""Byte-level BPE from a file of ranks, by the ``tokenizers`` library over Arrow batches.

The ranks become a vocabulary and merges of the library: every byte is mapped to a
printable character, and every way to split a token into two tokens is a merge, ordered
by the token's rank. Encoding gives ids and, on request, the character span of each
token; decoding goes back from characters to bytes, so that a character split over
tokens is whole again once their bytes are joined.

Cases: null and empty texts have no tokens and decode to an empty text. Byte sequences
that are not valid text decode with replacement characters, or as bytes.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.llm.tokens import Coder, byte_characters, column_ids
from spanworks.llm.words import prepare


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def tokenizer_of(path: str, pattern: str = public_tokenizers.PATTERN):
    """A tokenizer of the library with the vocabulary and merges of a rank file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, shown = read_ranks(path), byte_characters()
    text = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [
        (text[token[:k]], text[token[k:]])
        for token, _ in sorted(ranks.items(), key=lambda x: x[1])
        for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks
    ]
    model = models.BPE(vocab={text[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer


@lru_cache(maxsize=2)
def byte_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens in the order of their ids, and their bounds."""
    back = {c: b for b, c in enumerate(byte_characters())}
    vocab = tokenizer_of(path).get_vocab()
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, number in vocab.items():
        tokens[number] = bytes(back[c] for c in token)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    flat, bounds = byte_table(path)
    begin, size = bounds[ids], bounds[ids.astype(np.int64) + 1] - bounds[ids]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)].tobytes()


def character_spans(ids: np.ndarray, text: bytes, path: str) -> np.ndarray:
    """(first, after the last) character of each token; a token of a split character spans all of it."""
    _, bounds = byte_table(path)
    ends = np.cumsum(bounds[ids.astype(np.int64) + 1] - bounds[ids])
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    heads = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return np.stack([heads[begins] - 1, heads[ends - 1]], 1) if len(ends) else np.zeros((0, 2), np.int64)


def _encode(path: str, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(tokenizer_of(path), public_tokenizers.PATTERN, lower=False)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"") if spans else None
            rows = list(column_ids(batch.column(1), coder))
            arrays = [batch.column(0), pa.array([i.tolist() for i in rows], pa.list_(pa.int32()))]
            if spans:
                both = [character_spans(i, t.as_py(), path) for i, t in zip(rows, texts)]
                arrays += [pa.array([s[:, k].tolist() for s in both], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids", "begins", "ends"][: len(arrays)])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [decode_bytes(np.array(i or [], np.uint32), path) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data], pa.string())],
                names=["doc_id", "bytes", "text"])

    return run


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(tokenizer_of(path), public_tokenizers.PATTERN, lower=False)
        for batch in batches:
            rows = [
                (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode_bytes(ids, path)).hexdigest())
                for ids in column_ids(batch.column(1), coder)
            ]
            counts, of_ids, of_bytes = list(zip(*rows)) or ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def default_path() -> str:
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _texts(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, path: str | None = None, spans: bool = False) -> DataFrame:
    """(doc_id, ids) of each row, with the characters ``begins`` and ``ends`` of each token if ``spans``."""
    schema = "doc_id long, ids array<int>" + ", begins array<int>, ends array<int>" * spans
    return _texts(docs).mapInArrow(_encode(path or default_path(), spans), schema)


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, bytes, text) of each row of (doc_id, ids)."""
    prepare(coded.sparkSession)
    return coded.select("doc_id", "ids").mapInArrow(_decode(path or default_path()), "doc_id long, bytes binary, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again."""
    return _texts(docs).mapInArrow(
        _digests(path or default_path()), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
