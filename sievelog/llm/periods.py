"""Runs of repeated words, found by catching squares while the text grows.

*Catchers.* At each level the words are cut into blocks of ``L = 1, 2, 4, ...`` words. A completed block becomes a
catcher: for the next ``2 L`` places it compares itself with the words that arrive, and a copy at a distance ``q`` from
``L`` to ``2 L - 1`` is caught. Every place has one catcher per level, so an appended word costs one comparison of
names per level; the name of a window of ``2 L`` words comes from the names of its halves. Two neighbouring blocks
caught at the same distance prove a square of period ``q``, since ``2 L > q``. It is compared word by word backwards to
its start and forwards to its end. A square that reaches the end of the text stays open: each appended word advances its
suffix comparison until one differs, and all squares of the period merge into the run.

*Completeness.* Where words ``q`` apart agree over ``3 q`` words, two whole blocks of the level ``L <= q < 2 L`` lie
inside, so every run of four or more repetitions is caught. A square inside a run of a smaller period has that run's
period as its smallest and is skipped; by the theorem of Fine and Wilf no square of another smallest period lies there.

A run counts if its length is at least ``LEAST_WORDS`` and ``LEAST_POWER`` times its period. Words are runs of anything
but ASCII white space and are compared as bytes. Null, empty and blank texts have no words and no runs. Repeated rows are
judged each; ties of the longest run go to the smallest start, then period. Texts of any length are taken whole; other
columns stay in ``row``, whatever their names; empty tables give empty tables. Every row is handled where it is read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sievelog.llm import text as X
from sievelog.session import ship_package

LEAST_WORDS, LEAST_POWER = 6, 4
BATCH_WORDS = 200_000
RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class _Growing:
    """An array that doubles its room when appended to."""

    def __init__(self, kind):
        self._room, self.size = np.empty(16, kind), 0

    def append(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self._room):
            self._room = np.concatenate([self._room[: self.size], np.empty(max(need, 2 * self.size) - self.size, self._room.dtype)])
        self._room[self.size : need] = values
        self.size = need

    @property
    def all(self) -> np.ndarray:
        return self._room[: self.size]


class Catchers:
    """Runs of a growing sequence of word numbers; words may be appended singly or many at a time."""

    def __init__(self, longest: int = 1 << 62):
        """``longest`` bounds the length of any repeated stretch and so the levels."""
        self.longest = longest
        self._words = _Growing(np.int64)
        self._names: list[_Growing] = []
        self._pairs: list[_Growing] = []
        self._caught: list[_Growing] = []
        self._open: list[list[int]] = []
        self._closed: list[list[int]] = []

    def append(self, words: np.ndarray) -> None:
        before = self._words.size
        self._words.append(words)
        still = []
        for run in self._open:
            run[1] = self._agrees(before, run[2])
            (still if run[1] == self._words.size else self._closed).append(run)
        self._open = still
        level = 0
        while (4 << level) <= min(self.longest, self._words.size):
            self._advance(level)
            level += 1

    def _agrees(self, at: int, period: int) -> int:
        """The first place from ``at`` on whose word differs from the one a period before, or the end."""
        words, step = self._words.all, 64
        while at < len(words):
            differs = words[at : at + step] != words[at - period : at - period + min(step, len(words) - at)]
            if differs.any():
                return at + int(differs.argmax())
            at, step = at + len(differs), 4 * step
        return at

    def _advance(self, level: int) -> None:
        if level == len(self._names):
            self._names.append(_Growing(np.uint64))
            self._caught.append(_Growing(bool))
            self._pairs.append(_Growing(bool))
        size = 1 << level
        names, caught, pairs = self._names[level], self._caught[level], self._pairs[level]
        first, last = names.size, self._words.size - size + 1
        if first >= last:
            return
        if level:
            halves = self._names[level - 1].all
            left, right = halves[first:last], halves[first + size // 2 : last + size // 2]
            names.append(_mixed(left * np.uint64(0x9E3779B97F4A7C15) + (right ^ np.uint64(0xC2B2AE3D27D4EB4F))))
        else:
            names.append(_mixed(self._words.all[first:last].view(np.uint64) + np.uint64(0x165667B19E3779F9)))
        # each place meets the block before its own
        at = np.arange(first, last)
        block = (at // size - 1) * size
        known = names.all
        same = block >= 0
        same &= known[first:last] == known[np.maximum(block, 0)]
        caught.append(same)
        pairs.append(same & self._back(caught.all, first, last, size))
        heads = at[pairs.all[first:last] & ~self._back(pairs.all, first, last, size)]
        if len(heads):
            self._catch(heads, size)

    @staticmethod
    def _back(flags: np.ndarray, first: int, last: int, size: int) -> np.ndarray:
        """The flags ``size`` places before each of first to last."""
        out = np.zeros(last - first, bool)
        skip = max(0, size - first)
        out[skip:] = flags[first + skip - size : last - size] if skip < last - first else False
        return out

    def _catch(self, heads: np.ndarray, size: int) -> None:
        """Squares whose second caught copy starts at ``heads``, unless inside a run of a smaller period."""
        words = self._words.all
        known = sorted((r[0], r[1]) for r in (*self._closed, *self._open) if r[2] < size)
        starts = [s for s, _ in known]
        reach = np.maximum.accumulate([e for _, e in known]) if known else []
        for x in heads.tolist():
            s = (x // size - 1) * size
            period, low = x - s, s - size
            i = bisect.bisect_right(starts, low)
            if i and reach[i - 1] >= x + size:
                continue
            if not np.array_equal(words[low : s + size], words[low + period : x + size]):
                continue  # equal names of different words
            from_ = max(0, low - size)
            differs = np.flatnonzero(words[from_:low] != words[from_ + period : low + period])
            start = from_ + int(differs[-1]) + 1 if len(differs) else from_
            end = self._agrees(x + size, period)
            (self._open if end == len(words) else self._closed).append([start, end, period])

    def runs(self, least: int = LEAST_WORDS, power: int = LEAST_POWER) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs so far, by start, then period."""
        found = ((s, e - s, p) for s, e, p in (*self._closed, *self._open))
        return sorted(r for r in found if r[1] >= max(least, power * r[2]))


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Equal numbers for equal words, over all texts."""
    flat = pa.array([w for words in texts for w in words], pa.binary())
    numbers = flat.dictionary_encode().indices.to_numpy().astype(np.int64)
    return np.split(numbers, np.cumsum([len(w) for w in texts])[:-1])


def find_runs(texts: list[list[bytes]], least: int = LEAST_WORDS, power: int = LEAST_POWER) -> list[list[tuple[int, int, int]]]:
    """Runs of several texts. Texts of similar length share catchers, with a separator of its own after each."""
    if power < LEAST_POWER:
        raise ValueError(f"runs of fewer than {LEAST_POWER} repetitions may escape the catchers")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    numbers = _numbered(texts) if texts else []
    classes: dict[int, list[int]] = {}
    for i, words in enumerate(texts):
        if len(words) >= max(least, power):
            classes.setdefault(len(words).bit_length(), []).append(i)
    for members in classes.values():
        sizes = np.array([len(texts[i]) + 1 for i in members])
        ends = np.cumsum(sizes)
        catchers = Catchers(int(sizes.max()))
        catchers.append(np.concatenate([x for k, i in enumerate(members) for x in (numbers[i], [-1 - k])]))
        for start, length, period in catchers.runs(least, power):
            k = int(np.searchsorted(ends, start, side="right"))
            out[members[k]].append((start - int(ends[k] - sizes[k]), length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, of each run only the first period."""
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(documents: DataFrame, text: str = "text", least: int = LEAST_WORDS, power: int = LEAST_POWER) -> DataFrame:
    """Per document: (row, n_words, runs, collapsed). Runs are sorted by start, then period."""
    ship_package(documents.sparkSession)
    rows = documents.select(F.struct("*").alias("row"))

    def judged(whole: list[bytes]) -> Iterator[tuple[int, list[dict], bytes]]:
        texts = [t.split() for t in whole]
        for words, runs in zip(texts, find_runs(texts, least, power)):
            yield len(words), [dict(zip(("start", "length", "period"), r)) for r in runs], collapse(words, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).field(text).cast(pa.binary()).to_pylist()]
            out, held, size = [], [], 0
            for t in texts:
                held.append(t)
                size += len(t) // 6 + 1
                if size >= BATCH_WORDS:
                    out += judged(held)
                    held, size = [], 0
            out += judged(held)
            n, runs, kept = list(zip(*out)) or [()] * 3
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())]
            yield pa.record_batch(columns, ["row", "n_words", "runs", "collapsed"])

    schema = T.StructType([rows.schema["row"]]).add("n_words", "long").add("runs", T.ArrayType(RUN)).add("collapsed", "binary")
    return rows.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))


def longest_run(runs: Column) -> Column:
    """The run of greatest length; ties go to the smallest start, then period. Null without runs."""
    ranked = F.transform(runs, lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    best = F.array_max(ranked)
    return F.when(best.isNotNull(), F.struct((-best["col2"]).alias("start"), best["length"].alias("length"), (-best["col3"]).alias("period")))


def repeat_tail(text: Column, h: Column) -> Column:
    """One text in ten, by the number ``h``, with its words from a place on replaced by a few repetitions of the first of them.

    The words of such a text are joined by one space, which changes none of them; other texts stay as they are.
    """
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        copied = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(copied, " ")).otherwise("")

    words = F.array_remove(F.split(X.whole(text), X.SPACE_RUN), "")
    return F.when(h % 10 == 0, X.bind(words, repeated)).otherwise(text)
