"""Line de-duplication with reference counts that documents can be added to and removed from.

A line's key is the line stripped of ASCII white space and lower-cased in A-Z. Keys of at least ``MIN_CHARS`` code
points that ``MIN_DOCS`` documents hold lose all their lines but those of the highest ``doc_id`` holding it.

The index is a folder of tables, each written once per batch:

* ``postings``: which document holds which key (128-bit digest);
* ``counts``: per key the documents gained or lost in the batch and the highest id among those gained, so the exact
  reference count is a sum and a removed document takes back just what it brought;
* ``filters``: per shard a cuckoo filter of the keys that are repeated at present. Keys that become repeated are
  inserted, keys that cease to be are deleted. Lookups ask the filter first, and only its hits go to the exact table.

Rows are documents: repeated rows count once each, and rows that share the highest id all keep their lines. A null
text is one empty line. Null ids are below all others. Lines without a long key always stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelog.operators.lookup import spread_lookup
from sievelog.session import scratch_path, ship_package

MIN_CHARS, MIN_DOCS = 20, 3
FILTER_BYTES = 64 << 20
SPACES = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Digest of each line's key, None where the key is short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line.strip(SPACES).lower()
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(hashlib.md5(key, usedforsecurity=False).digest() if long else None)
    return out


class CuckooFilter:
    """Set of digests in two-choice buckets of four 16-bit marks; full filters answer yes to everything."""

    SLOTS, TRIES = 4, 500

    def __init__(self, buckets: int, table: bytes | None = None, full: bool = False):
        self.mask, self.full = buckets - 1, full
        self.table = np.zeros((buckets, self.SLOTS), np.uint16)
        if table is not None:
            self.table = np.frombuffer(table, np.uint16).reshape(-1, self.SLOTS).copy()

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Room for twice as many keys."""
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, 2 * keys) / (0.9 * cls.SLOTS))))))

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two buckets and the mark of each digest, given as two words each."""
        mark = (digests[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
        mark[mark == 0] = 1
        one = (digests[:, 0] & np.uint64(self.mask)).astype(np.int64)
        return one, self._other(one, mark), mark

    def _other(self, bucket, mark):
        return bucket ^ ((mark * 0x5BD1E995) >> 3 & self.mask)

    def insert(self, digests: np.ndarray) -> None:
        rng = np.random.default_rng(len(digests))
        for a, b, m in zip(*(x.tolist() for x in self._places(digests))):
            if self.full:
                return
            for bucket in (a, b):
                empty = np.flatnonzero(self.table[bucket] == 0)
                if len(empty):
                    self.table[bucket, empty[0]] = m
                    break
            else:
                for _ in range(self.TRIES):
                    slot = int(rng.integers(self.SLOTS))
                    m, self.table[b, slot] = int(self.table[b, slot]), m
                    b = self._other(b, m)
                    empty = np.flatnonzero(self.table[b] == 0)
                    if len(empty):
                        self.table[b, empty[0]] = m
                        break
                else:
                    self.full = True

    def delete(self, digests: np.ndarray) -> None:
        """Take out keys that were inserted."""
        for a, b, m in zip(*(x.tolist() for x in self._places(digests))):
            for bucket in (a, b):
                held = np.flatnonzero(self.table[bucket] == m)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break

    def contains(self, digests: np.ndarray) -> np.ndarray:
        if self.full:
            return np.ones(len(digests), bool)
        a, b, m = self._places(digests)
        return (self.table[a] == m[:, None]).any(1) | (self.table[b] == m[:, None]).any(1)


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)


def _row(documents: DataFrame) -> DataFrame:
    """Documents as (row, id, text, tie), free of clashes with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    docs = documents.select(row).select("row", F.col("row.doc_id").cast("long").alias("id"))
    return docs.withColumn("text", F.coalesce("row.text", F.lit(""))).withColumn("tie", F.xxhash64("text"))


class LineIndex:
    """Reference counts of line keys below a folder; ``batch`` is the number of batches written."""

    POSTING = "id long, tie long, key binary"
    COUNT = "key binary, n long, top long"

    def __init__(self, spark: SparkSession, path: str, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS):
        self.spark, self.path, self.min_docs, self.min_chars = spark, path, min_docs, min_chars
        self.shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.batch, self.added = 0, []
        ship_package(spark)

    def _at(self, kind: str, batch: int) -> str:
        return f"{self.path}/{kind}/{batch}"

    def _read(self, kind: str, schema: str, batches: list[int]) -> DataFrame:
        paths = [self._at(kind, b) for b in batches]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def insert(self, documents: DataFrame) -> None:
        """Add documents. Their ids may be any, also of documents added before."""
        min_chars = self.min_chars

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, ties, keys = [], [], []
                for i, tie, text in zip(*(c.to_pylist() for c in batch.columns)):
                    held = set(line_keys(text.encode(), min_chars)) - {None}
                    ids += [i] * len(held)
                    ties += [tie] * len(held)
                    keys += held
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(ties, pa.int64()), pa.array(keys, pa.binary())], ["id", "tie", "key"]
                )

        rows = _row(documents).select("id", "tie", "text")
        rows.mapInArrow(post, self.POSTING).write.parquet(self._at("postings", self.batch))
        new = self._read("postings", self.POSTING, [self.batch])
        self._count(new.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")))
        self.added.append(self.batch - 1)

    def delete(self, ids: DataFrame) -> None:
        """Remove all documents added so far that have one of these ids."""
        gone = ids.select(F.col("doc_id").cast("long").alias("id")).distinct()
        lost = self.live().join(gone, "id", "left_semi")
        gone.write.parquet(self._at("deletes", self.batch))
        self._count(lost.groupBy("key").agg((-F.count(F.lit(1))).alias("n"), F.lit(None).cast("long").alias("top")))

    def live(self) -> DataFrame:
        """Postings of the documents not removed since they were added."""
        removed = [b for b in range(self.batch) if b not in self.added]
        out = None
        for b in self.added:
            part = self._read("postings", self.POSTING, [b])
            later = [r for r in removed if r > b]
            if later:
                part = part.join(self._read("deletes", "id long", later).distinct(), "id", "left_anti")
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], self.POSTING) if out is None else out

    def _count(self, change: DataFrame) -> None:
        change.write.parquet(self._at("counts", self.batch))
        self.batch += 1
        self._refilter()

    def counts(self) -> DataFrame:
        """Exact reference table: (key, n, top, lost), lost telling that documents left since."""
        deltas = self._read("counts", self.COUNT, list(range(self.batch)))
        out = deltas.groupBy("key").agg(
            F.sum("n").alias("n"), F.max("top").alias("top"), (F.min("n") < 0).alias("lost")
        )
        return out.where("n > 0")

    def repeated(self) -> DataFrame:
        """Keys held by at least ``min_docs`` documents: (key, keeper), the highest id holding them."""
        found = self.counts().where(F.col("n") >= self.min_docs)
        if len(self.added) == self.batch:
            return found.select("key", F.col("top").alias("keeper"))
        kept = found.where("not lost").select("key", F.col("top").alias("keeper"))
        lost = found.where("lost").select("key")
        again = self.live().join(lost, "key", "left_semi").groupBy("key").agg(F.max("id").alias("keeper"))
        return kept.unionByName(again)

    def _refilter(self) -> None:
        """Bring the shards' filters up to the last batch: insert keys that became repeated, delete those that ceased."""
        last, shard = self.batch - 1, F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")
        new = self._read("counts", self.COUNT, [last]).select("key", F.col("n").alias("moved"))
        if last:
            old = self._read("counts", self.COUNT, list(range(last))).groupBy("key").agg(F.sum("n").alias("before"))
            new = new.join(old, "key", "left")
        else:
            new = new.withColumn("before", F.lit(0).cast("long"))
        before = F.coalesce("before", F.lit(0))
        after = before + F.col("moved")
        was, now = before >= self.min_docs, after >= self.min_docs
        changed = new.where(was != now).select(shard.alias("shard"), "key", now.alias("now"))
        state = self._filters(last - 1) if last else self.spark.createDataFrame([], "shard int, buckets long, full boolean, marks binary")

        def update(held: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            ups, downs = moved.key[moved.now].tolist(), moved.key[~moved.now].tolist()
            if len(held):
                row = held.iloc[0]
                cuckoo = CuckooFilter(int(row.buckets), row.marks, bool(row.full))
            else:
                cuckoo = CuckooFilter.sized(len(ups))
            cuckoo.delete(_words(downs))
            cuckoo.insert(_words(ups))
            at = held.shard.iloc[0] if len(held) else moved.shard.iloc[0]
            return pd.DataFrame([{"shard": at, "buckets": cuckoo.mask + 1, "full": cuckoo.full, "marks": cuckoo.table.tobytes()}])

        both = state.groupBy("shard").cogroup(changed.groupBy("shard"))
        both.applyInPandas(update, "shard int, buckets long, full boolean, marks binary").write.parquet(self._at("filters", last))

    def _filters(self, batch: int) -> DataFrame:
        return self._read("filters", "shard int, buckets long, full boolean, marks binary", [batch])

    def candidates(self) -> DataFrame:
        """Live postings whose key may be repeated. Filters beyond ``FILTER_BYTES`` in all let every posting pass."""
        filters = self._filters(self.batch - 1)
        size = filters.agg(F.sum(F.octet_length("marks"))).head()[0] or 0
        if size > FILTER_BYTES:
            return self.live()
        held = self.spark.sparkContext.broadcast([tuple(r) for r in filters.collect()])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = {s: CuckooFilter(n, marks, full) for s, n, full, marks in held.value}
            for batch in batches:
                at, digests = batch.column("shard").to_numpy(), _words(batch.column("key").to_pylist())
                order = np.argsort(at, kind="stable")
                keep = np.zeros(len(at), bool)
                for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    if len(rows) and at[rows[0]] in shards:
                        keep[rows] = shards[at[rows[0]]].contains(digests[rows])
                yield batch.filter(pa.array(keep)).select(["id", "tie", "key"])

        shard = F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int").alias("shard")
        return self.live().select("id", "tie", "key", shard).mapInArrow(ask, self.POSTING)

    def dropped(self) -> DataFrame:
        """Per document that loses lines: (id, tie, keys)."""
        rows = spread_lookup(self.candidates(), ["key"], self.repeated(), ["id", "tie"], "inner")
        rows = rows.where(~F.col("id").eqNullSafe(F.col("keeper")))
        return rows.groupBy("id", "tie").agg(F.collect_set("key").alias("keys"))


def clean(documents: DataFrame, index: LineIndex) -> DataFrame:
    """The indexed documents without their repeated lines: (row, kept, n_lines, n_dropped)."""
    min_chars = index.min_chars
    rows, lost = _row(documents), index.dropped()
    same = rows["id"].eqNullSafe(lost["id"]) & (rows["tie"] == lost["tie"])
    rows = rows.join(lost, same, "left").select("row", "keys")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, keys in zip(batch.column(0).field("text").to_pylist(), batch.column(1).to_pylist()):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if keys:
                    gone = set(keys)
                    found = line_keys((text or "").encode(), min_chars)
                    lines = [line for line, key in zip(lines, found) if key not in gone]
                kept.append("\n".join(lines))
                n_dropped.append(n_lines[-1] - len(lines))
            yield pa.record_batch(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                ["row", "kept", "n_lines", "n_dropped"],
            )

    kind = documents.sparkSession.createDataFrame([], rows.select("row").schema).schema[0].dataType.simpleString()
    return rows.mapInArrow(cut, f"row {kind}, kept string, n_lines long, n_dropped long")


def dedup_lines(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Index the documents as one batch and clean them."""
    spark = documents.sparkSession
    index = LineIndex(spark, scratch_path(spark, "lines"), min_docs, min_chars)
    index.insert(documents)
    return clean(documents, index)
