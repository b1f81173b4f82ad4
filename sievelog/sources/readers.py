"""Scans of raw and labelled log files."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sievelog import schema
from sievelog.operators.parse import parse_logs
from sievelog.session import ship_package
from sievelog.sources.csv_records import read_quoted_csv
from sievelog.sources.tail import TailSource

_ROW_BITS = 33
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _size(spark: SparkSession, name: str, default: str) -> int:
    number, unit = re.fullmatch(r"(\d+)\s*([a-z]?)b?", spark.conf.get(name, default).strip().lower()).groups()
    return int(number) * _UNITS[unit]


def _block_bits(spark: SparkSession) -> int:
    """Log of a length no file split falls below, so that splits of a file have different block numbers."""
    shortest = min(
        _size(spark, "spark.sql.files.maxPartitionBytes", "128m"),
        _size(spark, "spark.sql.files.openCostInBytes", "4m"),
    )
    return max(shortest, 1).bit_length() - 1


def _text_only(value):
    """Drop undecodable bytes; valid lines pass untouched."""
    return F.when(F.is_valid_utf8(value), value).otherwise(
        F.translate(F.make_valid_utf8(value), "\ufffd", "")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, value)`` for every line of a text file, folder or pattern.

    ``line_no`` orders the lines of a file without a shuffle: the start of the file split, then the row inside
    the task that read it. It is unique in the file and increasing, not consecutive.
    """
    row = F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1)
    block = F.shiftright(F.col("_metadata.file_block_start"), _block_bits(spark))
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        (F.shiftleft(block, _ROW_BITS) + row).alias("line_no"),
        _text_only(F.col("value")).alias("value"),
    )


def read_logs(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parsed entries of the files at ``path``."""
    return parse_logs(read_lines(spark, path), "value", **options)


def read_labelled_json(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples from a JSON array; an absent label means normal."""
    df = spark.read.schema(schema.LABELLED).json(path, multiLine=True)
    return df.withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False)))


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled samples from a CSV with a header; the label column may be missing. Files are read in splits."""
    df = read_quoted_csv(spark, path)
    if "is_anomaly" not in df.columns:
        return df.withColumn("is_anomaly", F.lit(False))
    label = F.lower(F.trim(F.col("is_anomaly").cast("string")))
    return df.withColumn("is_anomaly", F.coalesce(label.isin("1", "1.0", "true"), F.lit(False)))


def read_unlabelled(spark: SparkSession, path: str, **options) -> DataFrame:
    """Training rows from raw logs: parsed, every one labelled normal."""
    return read_logs(spark, path, **options).withColumn("is_anomaly", F.lit(False))


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Training rows by file type: JSON array, CSV, or raw log lines for anything else."""
    if path.endswith(".json"):
        return read_labelled_json(spark, path)
    if path.endswith(".csv"):
        return read_labelled_csv(spark, path)
    return read_unlabelled(spark, path)


def stream_lines(
    spark: SparkSession,
    path: str,
    from_end: bool = False,
    max_files_per_trigger: int = 1000,
    started: str | None = None,
) -> DataFrame:
    """Lines of the complete text files arriving in a folder, as a stream of ``(file, ingest_ts, value)``.

    A file is read once: lines appended to it later are not delivered. Use :func:`follow_files` for growing files.

    ``from_end`` skips what was there at the start: only files written after ``started``. Give the same ``started``
    when a query restarts from its checkpoint; without it the time of this call is taken.
    """
    stream = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(path)
    if from_end:
        since = F.lit(started).cast("timestamp") if started else F.lit(_now())
        stream = stream.where(F.col("_metadata.file_modification_time") > since)
    return stream.select(
        F.col("_metadata.file_path").alias("file"),
        F.current_timestamp().alias("ingest_ts"),
        _text_only(F.col("value")).alias("value"),
    )


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.timezone.utc)


def follow_files(
    spark: SparkSession,
    path: str,
    from_end: bool = False,
    split_bytes: int | None = None,
    fail_on_data_loss: bool = True,
) -> DataFrame:
    """Lines of growing files as a stream of ``(file, at, ingest_ts, value)``; ``at`` is the line's first byte.

    ``path`` is a file, a folder, or a pattern for names in one folder. Lines appended to a file arrive once, also after
    a restart and after the file was rotated. ``from_end`` skips what was there when the query first started; a restart
    goes on from its checkpoint. See :mod:`sievelog.sources.tail`.
    """
    ship_package(spark)
    spark.dataSource.register(TailSource)
    options = {"fromEnd": str(from_end), "failOnDataLoss": str(fail_on_data_loss)}
    if split_bytes:
        options["splitBytes"] = str(split_bytes)
    stream = spark.readStream.format("tail").options(**options).load(path)
    text = F.col("value").cast("string")
    return stream.select("file", "at", F.current_timestamp().alias("ingest_ts"), _text_only(text).alias("value"))


def stream_table(
    spark: SparkSession, folder: str, name: str, table_schema: T.StructType, max_files_per_trigger: int = 1000
) -> DataFrame:
    """A stream over one table in a folder: the file ``name.parquet``, or the files of a folder of that name."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    spark.read.schema(table_schema).parquet(path)  # a stream over nothing would be empty and say nothing
    stream = spark.readStream.schema(table_schema).option("maxFilesPerTrigger", max_files_per_trigger)
    # a stream needs a folder or a pattern; this pattern matches the one path, whether file or folder
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")
