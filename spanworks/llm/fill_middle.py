"""Fill-in-the-middle forms of texts by piece tables.

A text stays where Spark put it. A piece table describes it by descriptors (buffer, begin,
end) over two kinds of immutable buffers: the text and the three marks. Cutting splits a
descriptor, an arrangement permutes the descriptors of prefix, middle, suffix and marks, and
a digest streams over them without joining them. To restore a text, its output becomes one
descriptor, is cut at the marks, and the inverse of the permutation puts it in order again.

A unit is a word with the white space before it, or white space at the end of the text (white
space: space and 0x09-0x0D). Where a text is cut, and into which form it is brought, depends on
the sha256 of ``SEED:doc_id`` alone, so every run and every executor decides alike.

Cases: a null text counts as empty. Empty texts, and those that hold a mark already, stay
plain: their output is the text, and they have no prefix or middle. A null doc_id hashes as
an empty one. Rows that repeat a doc_id are treated each for itself. Columns other than doc_id
and text are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.llm.words import prepare, split_words, text_pieces

#: The marks before prefix, suffix and middle, and the seed of the choices.
MARKS = (b"<P>", b"<S>", b"<M>")
SEED = 42
#: Percent of texts that are transformed, and of these the percent with the suffix first.
RATE, SUFFIX_FIRST = 50, 80

#: Parts 0 to 2 are prefix, middle and suffix; 3 to 5 are the marks of prefix, suffix and middle.
ORDERS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}
_TEXT, _MARK = 0, 1
_MARKED = re.compile(b"|".join(map(re.escape, MARKS)))


@dataclass(frozen=True)
class PieceTable:
    """A text as descriptors (buffer, begin, end) over buffers that never change."""

    buffers: tuple[bytes | memoryview, ...]
    pieces: tuple[tuple[int, int, int], ...]

    @staticmethod
    def of(text: bytes | memoryview) -> PieceTable:
        return PieceTable((text, b"".join(MARKS)), ((_TEXT, 0, len(text)),))

    def cut(self, places: Sequence[int]) -> PieceTable:
        """Splits descriptors so that one ends at each of the rising ``places``; empty ones are kept."""
        out, at, ahead = [], 0, list(places)
        for buffer, begin, end in self.pieces:
            size, low = end - begin, begin
            while ahead and ahead[0] <= at + size:
                high = begin + ahead.pop(0) - at
                out.append((buffer, low, high))
                low = high
            out.append((buffer, low, end))
            at += size
        return PieceTable(self.buffers, tuple(out))

    def with_marks(self) -> PieceTable:
        bounds = np.cumsum([0, *map(len, MARKS)]).tolist()
        return PieceTable(self.buffers, (*self.pieces, *((_MARK, a, b) for a, b in zip(bounds, bounds[1:]))))

    def arranged(self, order: Sequence[int]) -> PieceTable:
        return PieceTable(self.buffers, tuple(self.pieces[k] for k in order))

    def stream(self) -> Iterator[memoryview]:
        for buffer, begin, end in self.pieces:
            yield memoryview(self.buffers[buffer])[begin:end]

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.stream())


def inverse(order: Sequence[int]) -> list[int]:
    return [order.index(k) for k in range(len(order))]


def output_table(text: bytes | memoryview, form: str, places: tuple[int, int]) -> PieceTable:
    """The descriptors of a text's output; ``places`` are the bytes before the middle and before the suffix."""
    table = PieceTable.of(text)
    return table if form == "plain" else table.cut(places).with_marks().arranged(ORDERS[form])


def restored_table(output: bytes, form: str) -> PieceTable:
    """The descriptors of the text that was made into ``output``."""
    table = PieceTable.of(output)
    if form == "plain":
        return table
    order, places, at = ORDERS[form], [], 0
    for mark in (MARKS[k - 3] for k in order if k >= 3):
        at = output.index(mark, at)
        places += [at, at + len(mark)]
        at += len(mark)
    # nothing stands before the first mark
    return table.cut(places[1:]).arranged(inverse(order)[:3])


def choices(doc_id: int | None) -> tuple[int, int, int, int]:
    number = "" if doc_id is None else str(doc_id)
    return struct.unpack(">4I", hashlib.sha256(f"{SEED}:{number}".encode()).digest()[:16])


@dataclass(frozen=True)
class Choice:
    """How one text is transformed; ``text`` is a view of its bytes."""

    text: memoryview
    units: int
    form: str
    places: tuple[int, int] = (0, 0)
    prefix_chars: int | None = None
    middle_chars: int | None = None


def choose(ids: Sequence[int | None], column: pa.Array, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> Iterator[Choice]:
    for low, high, data, bounds in text_pieces(column):
        words = split_words(data, bounds, lower=False)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        flat = memoryview(np.ascontiguousarray(data))
        for n, doc_id in enumerate(ids[low:high]):
            begin, end = int(bounds[n]), int(bounds[n + 1])
            first, after = int(words.first[n]), int(words.first[n + 1])
            tail = end > (int(words.end[after - 1]) if after > first else begin)
            units, text = after - first + tail, flat[begin:end]
            h1, h2, h3, h4 = choices(doc_id)
            if not units or h3 % 100 >= rate or _MARKED.search(text):
                yield Choice(text, units, "plain")
                continue
            stops = [begin, *words.end[first:after].tolist(), end][: units + 1 - tail] + [end] * tail
            a, b = (stops[k] for k in sorted((h1 % (units + 1), h2 % (units + 1))))
            yield Choice(text, units, "spm" if h4 % 100 < suffix_first else "psm", (a - begin, b - begin),
                         int(heads[a] - heads[begin]), int(heads[b] - heads[a]))


_CHOSEN = "n long, form string, prefix_chars long, middle_chars long"


def _columns(chosen: list[tuple]) -> list[pa.Array]:
    n, form, prefix, middle = list(zip(*chosen)) or [[]] * 4
    return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]


def _transform(rate: int, suffix_first: int, digests_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen, outputs, back = [], [], []
            for c in choose(batch.column(0).to_pylist(), batch.column(1), rate, suffix_first):
                chosen.append((c.units, c.form, c.prefix_chars, c.middle_chars))
                table = output_table(c.text, c.form, c.places)
                if digests_only:
                    outputs.append(table.sha256())
                    back.append(restored_table(table.content(), c.form).sha256())
                else:
                    outputs.append(table.content())
            columns = [batch.column(0), *_columns(chosen)]
            if digests_only:
                columns += [pa.array(outputs, pa.string()), pa.array(back, pa.string())]
                names = ["output_sha256", "restored_sha256"]
            else:
                columns.append(pa.array(outputs, pa.binary()).cast(pa.string()))
                names = ["output"]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", *names])

    return run


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        outputs = batch.column(2).cast(pa.binary()).fill_null(b"")
        texts = [restored_table(o.as_py(), f).content() for o, f in zip(outputs, batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])


def _texts(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def transform(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row; ``n`` counts the units of its text."""
    return _texts(docs).mapInArrow(_transform(rate, suffix_first, False), f"doc_id long, {_CHOSEN}, output string")


def restore(outputs: DataFrame) -> DataFrame:
    """(doc_id, text) of each row of (doc_id, form, output): the text before ``transform``."""
    prepare(outputs.sparkSession)
    return outputs.select("doc_id", "form", "output").mapInArrow(_restore, "doc_id long, text string")


def digests(docs: DataFrame, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """``transform`` with digests of the output and of the text restored from it, in place of the output."""
    return _texts(docs).mapInArrow(
        _transform(rate, suffix_first, True), f"doc_id long, {_CHOSEN}, output_sha256 string, restored_sha256 string")
