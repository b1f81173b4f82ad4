"""Token-id files of directly addressable codes.

Every id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of
those ids that have one, and so on. A bitmap per level tells which ids go on, and a rank directory holds the number
of set bits before each block of the bitmap, so the place of any id's next chunk is one look-up and one short count:
any token is read without decoding those before it.

A file is a Parquet table of segments. A segment holds whole documents, about ``SEGMENT`` tokens, with their ids and
sizes; segments follow in ascending order of ``doc_id``, null ids first, ties by text. A null text is empty and has
the end id alone. Repeated rows are written once each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelog.llm.encoder import encoder
from sievelog.session import ship_package

SEGMENT = 1 << 20
CHUNK_BITS = 8
BLOCK = 512

SCHEMA = (
    "part int, local_start long, n_tokens long, doc_ids array<bigint>, sizes array<bigint>, "
    "chunks array<binary>, bitmaps array<binary>, ranks array<binary>"
)


def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bitmaps and rank directories of all levels."""
    chunks, bitmaps, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        chunks.append((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes())
        rest = rest >> CHUNK_BITS
        more = rest > 0
        bitmaps.append(np.packbits(more, bitorder="little").tobytes())
        counts = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype("<u4").tobytes())
        rest = rest[more]
        if not len(rest):
            return chunks, bitmaps, ranks


class Codes:
    """Random access to the ids of one segment."""

    def __init__(self, chunks: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self._chunks = [np.frombuffer(c, np.uint8) for c in chunks]
        self._bitmaps = [np.frombuffer(b, np.uint8) for b in bitmaps]
        self._ranks = [np.frombuffer(r, "<u4") for r in ranks]

    def __len__(self) -> int:
        return len(self._chunks[0])

    def _before(self, level: int, at: np.ndarray) -> np.ndarray:
        """Set bits before each position: the directory's count, whole bytes of the block, the last byte's rest."""
        bits, block = self._bitmaps[level], at // BLOCK
        out = self._ranks[level][block].astype(np.int64)
        for step in range(BLOCK // 8):
            byte = block * (BLOCK // 8) + step
            inside = byte < at // 8
            out[inside] += np.bitwise_count(bits[byte[inside]])
        tail = at % 8 > 0
        out[tail] += np.bitwise_count(bits[at[tail] // 8] & ((1 << (at[tail] % 8)) - 1).astype(np.uint8))
        return out

    def get(self, positions: np.ndarray) -> np.ndarray:
        """Ids at any positions; each costs one look-up per level, whatever its place."""
        at = np.asarray(positions, np.int64)
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, chunks in enumerate(self._chunks):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            more = (self._bitmaps[level][at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1
            if not more.any():
                break
            at, live = self._before(level, at[more]), live[more]
        return out

    def all(self) -> np.ndarray:
        """All ids in order, level by level."""
        out = self._chunks[0].astype(np.uint32)
        live = np.arange(len(out))
        for level in range(1, len(self._chunks)):
            more = np.unpackbits(self._bitmaps[level - 1], count=len(live), bitorder="little").astype(bool)
            live = live[more]
            out[live] |= self._chunks[level].astype(np.uint32) << np.uint32(CHUNK_BITS * level)
        return out


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, parts: int | None = None) -> None:
    """Encode all documents and write their segments below ``path``, in order of ``doc_id``.

    The text moves once, to its range of ids; the ids are made where it arrives. Part numbers follow the order.
    """
    ship_package(documents.sparkSession)
    parts = parts or int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        held: list[tuple[int | None, bytes]] = []
        size = start = 0

        def flush() -> pa.RecordBatch:
            levels = pack(np.frombuffer(b"".join(x for _, x in held), "<u4"))
            row = [part, start, size, [i for i, _ in held], [len(x) // 4 for _, x in held], *levels]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            kinds += [pa.list_(pa.binary())] * 3
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                held.append((doc_id, ids))
                size += len(ids) // 4
                if size >= SEGMENT:
                    yield flush()
                    start, size, held = start + size, 0, []
        if held:
            yield flush()

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(segments, SCHEMA).write.parquet(path)


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """Number of ids before each part: one entry per part, as many as the writer's partitions."""
    sizes = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    out, before = {}, 0
    for part, n in sorted(sizes):
        out[part] = before
        before += n
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file: (doc_id, start, n_tokens, ids_crc32), from the decoded ids."""
    ship_package(spark)
    starts = part_starts(spark, path)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                ids = Codes(s["chunks"], s["bitmaps"], s["ranks"]).all().astype("<u4")
                ends = np.cumsum(s["sizes"])
                begins = ends - s["sizes"]
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(begins, ends)]
                first = starts[s["part"]] + s["local_start"]
                yield pa.record_batch(
                    [
                        pa.array(s["doc_ids"], pa.int64()),
                        pa.array(first + begins, pa.int64()),
                        pa.array(s["sizes"], pa.int64()),
                        pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    segments = spark.read.schema(SCHEMA).parquet(path)
    return segments.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Single ids by random access: ``wanted`` has (doc_id, position); returns them with ``token``.

    Positions outside their document are left out. Segments are matched by the documents they hold.
    """
    ship_package(spark)
    segments = spark.read.schema(SCHEMA).parquet(path).withColumn("_s", F.monotonically_increasing_id())
    held = segments.select("_s", F.posexplode("doc_ids").alias("_i", "doc_id"))
    asked = held.join(wanted, "doc_id").groupBy("_s").agg(F.collect_list(F.struct("_i", "doc_id", "position")).alias("asked"))
    joined = spark.read.schema(SCHEMA).parquet(path).withColumn("_s", F.monotonically_increasing_id()).join(asked, "_s")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                begins = np.cumsum(s["sizes"]) - s["sizes"]
                good = [a for a in s["asked"] if 0 <= a["position"] < s["sizes"][a["_i"]]]
                found = Codes(s["chunks"], s["bitmaps"], s["ranks"]).get([begins[a["_i"]] + a["position"] for a in good])
                yield pa.record_batch(
                    [pa.array([a["doc_id"] for a in good], pa.int64()), pa.array([a["position"] for a in good], pa.int64()), pa.array(found.astype(np.int64))],
                    ["doc_id", "position", "token"],
                )

    return joined.mapInArrow(tokens, "doc_id long, position long, token long")
