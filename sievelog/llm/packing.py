"""Best-fit packing into sequences of fixed length by patterns.

Lengths are counted over all documents. Patterns of up to three lengths that fill a sequence are enumerated on a
coarser scale, and non-negative least squares finds how often each is repeated so that together they use up the
histogram. The rounded counts are filled with exact lengths, the last one the longest that still fits. What is left
over goes, longest first, into the tightest place. All of this works on the histogram, whose size is the sequence
length and not the corpus; documents are then numbered within their length and looked up in the plan.

Null texts are empty and still have their separator. Repeated rows are packed once each; ties in length are
interchangeable.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sievelog.llm.encoder import encoder, tidy
from sievelog.session import ship_package, written

LENGTH = 4096
BUCKETS = 256
ROUNDS = 600


def patterns(parts: int, present: np.ndarray) -> np.ndarray:
    """Multisets of up to three of the ``present`` sizes that sum to ``parts``, one per row, zero-padded."""
    have = np.zeros(parts + 1, bool)
    have[present] = True
    out = [(parts, 0, 0)] if have[parts] else []
    for a in np.flatnonzero(have[1:]) + 1:
        if 2 * a <= parts and have[parts - a]:
            out.append((a, parts - a, 0))
        b = np.arange(a, (parts - a) // 2 + 1)
        out.extend((a, x, parts - a - x) for x in b[have[b] & have[parts - a - b]])
    return np.array(out, np.int64).reshape(-1, 3)


def fit_counts(pats: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts >= 0 of the patterns with the least squared difference to the histogram.

    Projected gradient steps with momentum; a pattern touches at most three sizes, so a step is linear in them.
    """
    if not len(pats):
        return np.zeros(0)
    n, live = len(histogram), (pats > 0).astype(float)

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(pats.ravel(), (live * x[:, None]).ravel(), n)

    def back(r: np.ndarray) -> np.ndarray:
        return (r[pats] * live).sum(1)

    v = np.ones(len(pats))
    for _ in range(30):
        v = back(used(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        after = np.maximum(0, y - back(used(y) - histogram) / (1.01 * top))
        t_after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = after + (t - 1) / t_after * (after - x)
        x, t = after, t_after
    return x


class Plan:
    """Groups of equal sequences being filled. A group is (number of sequences, last entry, free space)."""

    def __init__(self, length: int):
        self.length = length
        self.entries: list[tuple[int, int, int, int]] = []  # entry before, size, offset, copies in a row
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # by free space
        self.free = np.zeros(length + 1, bool)

    def put(self, before: int, space: int, size: int, copies: int, sequences: int) -> int:
        self.entries.append((before, size, self.length - space, copies))
        return len(self.entries) - 1

    def keep(self, entry: int, space: int, sequences: int) -> None:
        if sequences:
            self.open[space].append((entry, sequences))
            self.free[space] = True

    def fill(self, size: int, number: int) -> None:
        """Place ``number`` pieces of one size, tightest space first; a place takes as many as fit."""
        while number:
            fits = np.flatnonzero(self.free[size:])
            space = size + int(fits[0]) if len(fits) else self.length
            if len(fits):
                entry, have = self.open[space].pop()
                self.free[space] = bool(self.open[space])
            else:
                entry, have = -1, -(-number // (self.length // size))
            copies = min(space // size, number)
            full = min(have, number // copies)
            self.keep(self.put(entry, space, size, copies, full), space - copies * size, full)
            if len(fits):
                self.keep(entry, space, have - full)
            number -= full * copies

    def slots(self) -> np.ndarray:
        """Rows (size, first rank, sequences, first sequence id, offset, copies), sorted by size and rank."""
        out, ids = [], 0
        for groups in self.open:
            for entry, sequences in groups:
                while entry >= 0:
                    entry, size, offset, copies = self.entries[entry]
                    out.append((size, 0, sequences, ids, offset, copies))
                ids += sequences
        slots = np.array(sorted(out), np.int64).reshape(-1, 6)
        took = slots[:, 2] * slots[:, 5]
        before = np.cumsum(took) - took
        first = np.searchsorted(slots[:, 0], slots[:, 0])
        slots[:, 1] = before - before[first]
        return slots


def plan_packing(histogram: dict[int, int], length: int = LENGTH, buckets: int = BUCKETS) -> np.ndarray:
    """Slots for a histogram of lengths from 1 to ``length``."""
    left = np.zeros(length + 1, np.int64)
    for size, number in histogram.items():
        left[size] = number
    buckets = min(buckets, length)
    width = -(-length // buckets)
    coarse = np.bincount(-(-np.arange(length + 1) // width), left, -(-length // width) + 1)
    pats = patterns(len(coarse) - 1, np.flatnonzero(coarse))
    counts = np.floor(fit_counts(pats, coarse)).astype(np.int64)
    plan = Plan(length)

    def longest(low: int, high: int) -> int:
        found = np.flatnonzero(left[max(low, 1) : high + 1])
        return max(low, 1) + int(found[-1]) if len(found) else 0

    for j in np.argsort(-counts, kind="stable"):
        todo, sizes = int(counts[j]), [int(s) for s in sorted(pats[j], reverse=True) if s]
        while todo > 0:
            chosen: list[int] = []
            space = length
            for k, s in enumerate(sizes):
                last = k == len(sizes) - 1
                # the last one is the longest that fits, be it of the next size up
                size = longest(1 if last else (s - 1) * width + 1, min(space, length if last else s * width))
                if not size:
                    break
                left[size] -= 1
                chosen.append(size)
                space -= size
            for size in chosen:
                left[size] += 1
            if len(chosen) < len(sizes):
                break
            times = min([todo, *(int(left[s]) // chosen.count(s) for s in chosen)])
            entry, space = -1, length
            for size in chosen:
                entry = plan.put(entry, space, size, 1, times)
                left[size] -= times
                space -= size
            plan.keep(entry, space, times)
            todo -= times
    for size in range(length, 0, -1):
        plan.fill(size, int(left[size]))
    return plan.slots()


def pieces(documents: DataFrame, tokenizer: str, length: int = LENGTH, separator: int = 1) -> DataFrame:
    """Token pieces of all documents: (doc_id, piece, start, length, ids_crc32)."""
    end = np.array([separator], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(tidy(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def number_within_length(rows: DataFrame, salts: int) -> DataFrame:
    """Add ``_rank``, gapless from 0 among the rows of a length; a common length is numbered in ``salts`` parts."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    placed = salted.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = placed.join(counts, ["length", "_salt"])
    return joined.withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_salt", "_before")


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, separator: int = 1) -> DataFrame:
    """Pack all documents; one row per piece with its ``sequence_id`` and ``offset``."""
    ship_package(documents.sparkSession)
    cut = written(pieces(documents, tokenizer, length, separator), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan_packing(histogram, length)
    spark = documents.sparkSession
    plan = spark.sparkContext.broadcast(slots)  # bounded by the number of lengths and patterns
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, first, sequences, base, offset, _ = plan.value.T
        order = size * (1 << 48) + first
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(order, lengths * (1 << 48) + ranks, side="right") - 1
            within = ranks - first[at]
            ids, copy = base[at] + within % sequences[at], within // sequences[at]
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.record_batch(
                [*keep, pa.array(ids), pa.array(offset[at] + copy * lengths)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = number_within_length(cut, salts)
    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
