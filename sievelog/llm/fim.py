"""Fill-in-the-middle samples, cut by a Fenwick tree over fixed blocks of the text.

A text's UTF-8 bytes are cut into blocks of ``BLOCK``. Each block counts the units and the code points that end in it,
and a Fenwick tree sums those counts. A cut after ``k`` units descends the tree by halving steps to the block that holds
the end of the ``k``-th unit and then looks inside that block alone, so the second cut of a text costs a logarithm and
one block and no second walk over the text. Units are code points, or the matches of a pattern from left to right.

Four numbers per document, from a hash of its id, choose both cuts and the form: ``plain`` is the text itself, ``psm``
gives prefix, suffix, middle, ``spm`` suffix, prefix, middle, each part behind its mark. A text that is empty or holds a
mark stays plain. The text is rebuilt from output and form alone, see :func:`restored`.

Null texts are empty, and so plain. Repeated rows give the same output each; equal texts with different ids differ in
their cuts. A null id hashes as empty text. Other columns, whatever their names, stay in ``row``. Texts of any length
are cut whole; empty tables give empty tables. Every row is handled where it is read: no shuffle, no state.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sievelog.session import ship_package

BLOCK = 4096
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents: from this number on plain, and of the others, below this number suffix first.
PLAIN_FROM, SPM_BELOW = 90, 20


class BlockTree:
    """Units and code points of the blocks before any block, and the block in which the k-th unit ends."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        sums = np.zeros((2, len(units) + 1), np.int64)
        np.cumsum([units, points], axis=1, out=sums[:, 1:])
        at = np.arange(1, len(units) + 1)
        # node i holds the last (i & -i) blocks up to block i
        self._nodes = np.zeros_like(sums)
        self._nodes[:, 1:] = sums[:, at] - sums[:, at - (at & -at)]
        self._first_step = 1 << max(len(units).bit_length() - 1, 0)

    def add(self, block: int, units: int, points: int) -> None:
        """Change the counts of one block."""
        i = block + 1
        while i < self._nodes.shape[1]:
            self._nodes[:, i] += (units, points)
            i += i & -i

    def before(self, block: int) -> tuple[int, int]:
        """Units and code points in the blocks before this one."""
        units = points = 0
        while block:
            units += int(self._nodes[0, block])
            points += int(self._nodes[1, block])
            block -= block & -block
        return units, points

    def find(self, k: int) -> tuple[int, int, int]:
        """(block, unit inside it from 1, code points before the block) of the k-th unit, k >= 1."""
        block, points, step = 0, 0, self._first_step
        while step:
            ahead = block + step
            if ahead < self._nodes.shape[1] and self._nodes[0, ahead] < k:
                block = ahead
                k -= int(self._nodes[0, ahead])
                points += int(self._nodes[1, ahead])
            step >>= 1
        return block, k, points


class Cutter:
    """Cut places of one text."""

    def __init__(self, text: bytes, pattern: re.Pattern | None = None, block: int = BLOCK):
        self.block, data = block, np.frombuffer(text, np.uint8)
        # a code point ends where no continuation byte follows
        self._points = np.ones(len(data), bool)
        self._points[:-1] = (data[1:] & 0xC0) != 0x80
        self._units = self._points if pattern is None else self._matches(text.decode(), pattern)
        starts = np.arange(0, len(data), block)
        units = np.add.reduceat(self._units, starts, dtype=np.int64) if len(data) else np.zeros(0, np.int64)
        points = np.add.reduceat(self._points, starts, dtype=np.int64) if len(data) and pattern else units
        self.n = int(units.sum())
        self._tree = BlockTree(units, points)

    def _matches(self, text: str, pattern: re.Pattern) -> np.ndarray:
        ends = np.array([m.end() for m in pattern.finditer(text) if m.end() > m.start()], np.int64)
        out = np.zeros(len(self._points), bool)
        out[np.flatnonzero(self._points)[ends - 1]] = True
        return out

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) up to the end of the k-th unit; none for k = 0."""
        if not k:
            return 0, 0
        block, inside, points = self._tree.find(k)
        first = block * self.block
        at = int(np.flatnonzero(self._units[first : first + self.block])[inside - 1]) + 1
        return first + at, points + int(np.count_nonzero(self._points[first : first + at]))


def middle_last(
    text: bytes, draws: list[int], marks: tuple[bytes, ...], pattern: re.Pattern | None = None, block: int = BLOCK
) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text and its four numbers."""
    cutter = Cutter(text, pattern, block)
    h1, h2, h3, h4 = draws
    if not text or h3 % 100 >= PLAIN_FROM or any(m in text for m in marks):
        return cutter.n, "plain", None, None, text
    (a, points), (b, until) = (cutter.cut(k) for k in sorted((h1 % (cutter.n + 1), h2 % (cutter.n + 1))))
    p, s, m = marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_BELOW:
        return cutter.n, "spm", points, until - points, b"".join((s, suffix, p, prefix, m, middle))
    return cutter.n, "psm", points, until - points, b"".join((p, prefix, s, suffix, m, middle))


def _checked(marks: tuple[str, ...]) -> tuple[str, ...]:
    """Marks that no mixture of text and mark can imitate: their first character occurs nowhere else in them."""
    if len(set(marks)) != 3 or not all(marks) or any(m[0] in x[1:] for m in marks for x in marks):
        raise ValueError("three different marks are needed, whose first characters occur nowhere else in them")
    return marks


def fill_in_middle(
    documents: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    seed: int = 1,
    marks: tuple[str, ...] = MARKS,
    unit: str | None = None,
) -> DataFrame:
    """Per document: (row, n, form, prefix_chars, middle_chars, output). ``unit`` is a pattern; code points if not given."""
    ship_package(documents.sparkSession)
    ends, pattern = tuple(m.encode() for m in _checked(marks)), None if unit is None else re.compile(unit)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    draws = F.transform(F.sequence(F.lit(1), F.lit(25), F.lit(8)), lambda i: F.conv(F.substr(digest, i, F.lit(8)), 16, 10).cast("long"))
    rows = documents.select(F.struct("*").alias("row"), draws.alias("draws"))
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text).cast(pa.binary()).to_pylist()
            out = [middle_last(t or b"", d, ends, pattern) for t, d in zip(texts, batch.column(1).to_pylist())]
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.record_batch([batch.column(0), *map(pa.array, columns, kinds)], ["row", *names])

    schema = T.StructType([rows.schema["row"]])
    for name, kind in zip(names, (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.BinaryType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, ...] = MARKS) -> Column:
    """The text, from output and form."""
    parts = F.split(output, "|".join(re.escape(m) for m in _checked(marks)), 4)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .otherwise(F.concat(parts[2], parts[3], parts[1]))
    )
