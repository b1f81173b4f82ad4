"""Joins to a table of unique keys, safe when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def spread_lookup(
    rows: DataFrame,
    keys: Sequence[str],
    table: DataFrame,
    spread_by: Sequence[str],
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table`` on ``keys``, the rows of one key spread over ``salts`` parts.

    There are as many parts as shuffle partitions unless given, so a key is spread as widely as the work is.

    The salt is a hash of columns that differ between the rows of a key, so a re-run task finds the same parts.
    A table row is only copied to the parts its key occurs in, a set combined before it is shuffled.
    """
    salts = salts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    parts = salted.select(*keys, "_salt").distinct()
    return salted.join(parts.join(table, list(keys)), [*keys, "_salt"], how).drop("_salt")
