"""CSV records with line breaks inside quotes, read by many tasks.

Where a record starts depends on whether the quotes before it are paired, so a reader has to begin at the start of the
file, and the usual one reads each file in one task. Here the file is scanned in splits, twice:

1. the first scan counts the quotes of each split. Running sums over a file's splits, one row each, tell for every split
   whether it begins inside quotes;
2. with that, the second scan puts whole records together where it reads them. What belongs to a record of an earlier
   split, and what a later split completes, are fragments: at most two of a split. They alone are shuffled, and the
   fragments of one record are joined in order.

A doubled quote inside quotes counts twice and so changes nothing. Records are then split into fields by Spark's own
parser. Line breaks inside quotes are kept as they are, at the end of a record ``\\r`` is dropped; blank lines between
records are skipped. Quotes must be the escape of quotes, and line breaks ``\\n`` or ``\\r\\n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sievelog.session import ship_package, written

_FRAGMENT = "record string, file long, block long, kind int"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): lines in the order of their split; ``block`` is where the split starts."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _begins_inside(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a split begins inside quotes; one narrow row per split."""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


class Assembler:
    """Whole records and fragments from the lines of splits, in order. Kinds: 0 whole, 1 rest of a record, 2 start, 3 middle."""

    def __init__(self) -> None:
        self.at: tuple | None = None
        self.held: list[str] = []
        self.out: list[tuple] = []

    def line(self, file: int, block: int, value: str, inside: bool) -> None:
        if (file, block) != self.at:
            self.close()
            self.at, self.inside, self.foreign = (file, block), inside, inside
        self.held.append(value)
        if value.count('"') % 2:
            self.inside = not self.inside
        if not self.inside:
            self._emit(1 if self.foreign else 0)
            self.foreign = False

    def close(self) -> None:
        """The split ends; what is held goes on in the next one."""
        if self.held:
            self._emit(3 if self.foreign else 2)

    def _emit(self, kind: int) -> None:
        self.out.append(("\n".join(self.held), *self.at, kind))
        self.held = []

    def batch(self) -> pa.RecordBatch:
        columns, self.out = list(zip(*self.out)) or [()] * 4, []
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["record", "file", "block", "kind"])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = Assembler()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value", "inside"))):
            found.line(*row)
        yield found.batch()
    found.close()
    yield found.batch()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, file, block, first): the records of all files as text; ``first`` marks those that start a file."""
    ship_package(spark)
    lines = _lines(spark, path)
    # 17 bytes for each split of the scan
    inside = F.broadcast(written(_begins_inside(lines), "quotes"))
    pieces = written(lines.join(inside, ["file", "block"]).mapInArrow(_assembled, _FRAGMENT).withColumn("n", F.monotonically_increasing_id()), "records")
    whole = pieces.where("kind = 0").select("record", "file", "block", "n")
    parts = pieces.where("kind <> 0")
    # a start opens a record, whatever follows up to the next start belongs to it
    by_file = Window.partitionBy("file").orderBy("block", "n")
    opened = parts.withColumn("start", F.count_if(F.col("kind") == 2).over(by_file))
    joined = opened.groupBy("file", "start").agg(
        F.array_sort(F.collect_list(F.struct("block", "n", "record"))).alias("parts")
    )
    joined = joined.select(F.array_join("parts.record", "\n").alias("record"), "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["n"].alias("n"))
    records = whole.unionByName(joined)
    first = records.groupBy("file").agg(F.min(F.struct("block", "n")).alias("f"))
    records = records.join(F.broadcast(first), "file").withColumn("first", F.struct("block", "n") == F.col("f"))
    return records.select("record", "file", "block", "first")


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV files with a header, all columns text. Equal to a reader that takes each file whole."""
    names = spark.read.csv(path, header=True, escape='"').columns
    record = F.regexp_replace("record", "\r$", "")
    rows = read_records(spark, path).where(~F.col("first")).select(record.alias("record")).where(F.trim("record") != "")
    fields = F.from_csv("record", _ddl(names), {"escape": '"', "mode": "PERMISSIVE"})
    return rows.select(fields.alias("v")).select("v.*")


def _ddl(names: list[str]) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` string" for name in names)
