"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "sievelog", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "128m",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the one ``spark.checkpoint.dir`` names, else one below the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def written(df, name: str = "step"):
    """The same rows read back from a table in the shared folder: cuts lineage and survives executor loss.

    Unlike a checkpointed RDD the table has a known size, so adaptive planning can use it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application, so that functions which run in their Python find it."""
    context = spark.sparkContext
    if getattr(context, "_sievelog_shipped", None):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sievelog-")) / "sievelog_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(archive))
    context._sievelog_shipped = True
