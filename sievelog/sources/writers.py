"""Dataset, report and alert sinks."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelog.session import ship_package
from sievelog.sources.tail import file_system


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled so free text survives the round trip."""
    df.write.mode("overwrite").csv(
        path,
        header=True,
        escape='"',
        quoteAll=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_entries(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").parquet(path)


def metrics_report(parts: dict[str, DataFrame]) -> DataFrame:
    """Metric tables of any shape as one ``(section, row)`` table with the row as JSON text."""
    tables = [
        df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("row"))
        for name, df in parts.items()
    ]
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def write_metrics(parts: dict[str, DataFrame], path: str) -> None:
    metrics_report(parts).write.mode("overwrite").json(path)


def append_outbox(payloads: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append alert payloads to the outbox table.

    A replayed micro-batch overwrites its own folder, so a restart never duplicates deliveries.
    """
    if batch_id is None:
        payloads.write.mode("append").parquet(path)
    else:
        payloads.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_outbox(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("alert_id", "channel", "ts", "payload")


def write_log_files(lines: DataFrame, path: str, file: str, order: Sequence[str], text: str = "line") -> None:
    """Each file's lines in order, as a plain file below ``path``; a file that is there is replaced at once.

    A file that got more lines at its end has grown for whoever follows it. A task that is run again writes the same.
    """
    ship_package(lines.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(path)
        files.create_dir(folder)
        name = out = hidden = None

        def close() -> None:
            if out is not None:
                out.close()
                files.move(hidden, posixpath.join(folder, name))

        for batch in batches:
            for to, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if to != name:
                    close()
                    name, hidden = to, posixpath.join(folder, f".{to}-{uuid.uuid4().hex}")
                    out = files.open_output_stream(hidden)
                out.write(f"{line}\n".encode())
        close()
        return iter(())

    placed = lines.repartition(F.col(file)).sortWithinPartitions(file, *order).select(file, text)
    placed.mapInArrow(write, "file string").write.format("noop").mode("overwrite").save()
