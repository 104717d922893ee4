"""Surface features of stretches of words, for many texts at once.

A stretch is a run of words of one text (a passage or a line). The features depend on its
characters and on repetition alone, not on any language or vocabulary.
"""

from __future__ import annotations

import numpy as np

from spanworks.llm.words import Words, mix, word_hashes

#: Characters of markup and tables.
SYMBOLS = b"#*$%&|<>"
NAMES = (
    "log_words", "word_length", "symbols", "exclamations", "capitals", "digits", "beyond_ascii", "same_as_last",
    "seen_in_text", "seen_in_stretch", "marked_words", "bare_signs", "short_words", "ends_sentence",
)


def _table(*ranges: range) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[list(r)] = True
    return out


SYMBOL = _table(SYMBOLS)
_UPPER, _DIGIT = _table(range(65, 91)), _table(range(48, 58))
_SIGN = _table(range(33, 48), range(58, 65), range(91, 97), range(123, 127))
_HEAD = ~_table(range(0x80, 0xC0))
_WIDE_HEAD = _table(range(0xC0, 256))
_MARK, _STOP = _table(b".,;:!?"), _table(b".!?")


def counter(flags: np.ndarray) -> np.ndarray:
    """Prefix counts: how many flags are set before each position."""
    out = np.zeros(len(flags) + 1, np.int32)
    np.cumsum(flags, out=out[1:], dtype=np.int32)
    return out


def earlier_places(words: Words, hashes: np.ndarray) -> np.ndarray:
    """For each word, the place of the same word before it in its text, or -1."""
    text = np.repeat(np.arange(len(words.first) - 1), words.counts)
    keys = mix(hashes + mix(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), -1, np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def stretch_features(words: Words, edges: np.ndarray) -> np.ndarray:
    """One row of features per stretch ``edges[i]:edges[i + 1]`` of words; none is empty."""
    low, high = edges[:-1], edges[1:]
    if not len(low):
        return np.zeros((0, len(NAMES)), np.float32)
    data, start, end = words.data, words.start, words.end
    n = (high - low).astype(np.float64)

    def total(per_word: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(per_word)])
        return sums[high] - sums[low]

    def of_bytes(table: np.ndarray) -> np.ndarray:
        counts = counter(table[data])
        return counts[end] - counts[start]

    length, signs = of_bytes(_HEAD), of_bytes(_SIGN)
    chars = np.maximum(total(length), 1)
    hashes = word_hashes(words)
    before = earlier_places(words, hashes)
    place = np.arange(len(hashes))
    inside = before >= np.repeat(low, high - low) if len(place) else before >= 0
    columns = [
        np.log1p(n), total(length) / n, total(of_bytes(SYMBOL)) / n, total(of_bytes(_table(b"!"))) / n,
        total(of_bytes(_UPPER)) / chars, total(of_bytes(_DIGIT)) / chars, total(of_bytes(_WIDE_HEAD)) / chars,
        total((before >= 0) & (before == place - 1)) / n, total(before >= 0) / n, total(inside & (before >= 0)) / n,
        total(_MARK[data[end - 1]]) / n, total(signs == length) / n, total(length <= 3) / n,
        _STOP[data[end[high - 1] - 1]].astype(float),
    ]
    return np.stack(columns, 1).astype(np.float32)
