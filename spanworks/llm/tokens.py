"""Token ids of whole Arrow columns: each distinct unit of text is encoded once.

A unit ends before a space that is followed by a character other than white space, and
between ASCII letters, digits and other signs (but never beside an apostrophe). The
patterns of the tokenizers used here split at all these places, so the ids of a text are
those of its units, one after the other. Units are found in the bytes of the column and
numbered by Arrow; the ``tokenizers`` library sees each distinct one once per cache.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from spanworks.llm.words import text_pieces

#: Distinct units and distinct matches kept per task; beyond that they are gathered anew.
CACHE = 250_000
#: Bytes of text taken at once.
PIECE = 4 << 20

# classes of bytes: 1 letter, 2 digit, 3 other printable but the apostrophe, 0 the rest
_CLASS = np.zeros(256, np.int8)
_CLASS[33:127] = 3
_CLASS[[*range(65, 91), *range(97, 123)]] = 1
_CLASS[48:58] = 2
_CLASS[39] = 0
# bytes that may follow the space of a cut: not white space, not a control character,
# and not the lead of a character that may be white space (U+0085, U+00A0, U+1680, U+20xx, U+3000)
_CUT = np.ones(256, bool)
_CUT[:33] = _CUT[127] = False
_CUT[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def unit_column(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The units of some texts as one string column, and the bounds of each text's units."""
    mark = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        kind, left, right = _CLASS[data], data[:-1], data[1:]
        mark[:-2] = (left == 0x20) & _CUT[right]
        mark[1:-1] |= (kind[:-1] != kind[1:]) & (kind[:-1] > 0) & (kind[1:] > 0)
    mark[bounds] = True
    places = np.flatnonzero(mark)
    units = pa.StringArray.from_buffers(
        len(places) - 1, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return units, np.searchsorted(places, bounds)


#: Units of these characters alone are split here: printable ASCII, white space, Latin letters.
_PLAIN = re.compile("[\\t\\n\\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*").fullmatch


def byte_characters() -> list[str]:
    """The printable character of each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Coder:
    """Ids of units by a byte-level tokenizer of the ``tokenizers`` library.

    Plain units are split by the tokenizer's own pattern and each distinct match goes to
    the library's model; any other unit goes through the whole tokenizer.
    """

    def __init__(self, tokenizer, pattern: str, lower: bool):
        self.tokenizer, self.model, self.lower = tokenizer, tokenizer.model, lower
        self.find = regex.compile(pattern).findall
        self.shown = dict(enumerate(byte_characters()))
        self.units: dict[str, list[int]] = {}
        self.matches: dict[str, list[int]] = {}

    def _match(self, match: str) -> list[int]:
        ids = self.matches.get(match)
        if ids is None:
            shown = match.encode().decode("latin-1").translate(self.shown)
            ids = self.matches[match] = [t.id for t in self.model.tokenize(shown)]
        return ids

    def _unit(self, unit: str) -> list[int]:
        if not _PLAIN(unit):
            return self.tokenizer.encode(unit, add_special_tokens=False).ids
        body = unit[1:] if unit[0] == " " else unit
        if body.isalpha():
            return self._match(body.lower() if self.lower else unit)
        return [i for match in self.find(unit.lower() if self.lower else unit) for i in self._match(match)]

    def encode(self, units: list[str]) -> list[list[int]]:
        if len(self.matches) > CACHE:
            self.matches.clear()
        if len(self.units) > CACHE:
            self.units.clear()
        known, unit_ids = self.units, self._unit
        for unit in units:
            if unit not in known:
                known[unit] = unit_ids(unit)
        return [known[u] for u in units]


def column_ids(column: pa.Array, coder: Coder) -> Iterator[np.ndarray]:
    """The ids of each text of a string column, as 32-bit arrays; null counts as empty."""
    for low, high, data, bounds in text_pieces(column, PIECE):
        if not len(data):
            yield from (np.zeros(0, np.uint32) for _ in range(high - low))
            continue
        units, first = unit_column(data, bounds)
        coded = units.dictionary_encode()
        each = coder.encode(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, each), np.int32, len(each))
        flat = np.fromiter(chain.from_iterable(each), np.uint32, int(sizes.sum()))
        begin = np.cumsum(sizes, dtype=np.int32) - sizes
        which = coded.indices.to_numpy()
        lengths = sizes[which]
        ends = np.cumsum(lengths, dtype=np.int32)
        ids = flat[np.arange(ends[-1], dtype=np.int32) + np.repeat(begin[which] - (ends - lengths), lengths)]
        bound = np.concatenate([[0], ends])[first]
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist()):
            yield ids[a:b]


@lru_cache(maxsize=4)
def load(path: str):
    """A tokenizer of the ``tokenizers`` library from its JSON file, special tokens as plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer
