"""Runs registered queries in Spark and their SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb

ROOT = os.environ.get("SIEVELOG_TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if value is None:
        return "\0"
    if hasattr(value, "quantize"):
        return _norm(float(value))
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else str(value)
    return str(value)


def _rows(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in at) for r in rows)


def compare(df, con, sql):
    """None when equal, else a description of the difference."""
    spark_columns = df.columns
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    expected = found.fetchall()
    if sorted(columns) != sorted(spark_columns):
        return f"columns differ: spark {sorted(spark_columns)} sql {sorted(columns)}"
    a = _rows(spark_columns, [tuple(r) for r in df.collect()])
    b = _rows(columns, expected)
    if a == b:
        return None
    from collections import Counter

    ca, cb = Counter(a), Counter(b)
    extra, missing = list((ca - cb).elements())[:3], list((cb - ca).elements())[:3]
    return f"rows spark {len(a)} sql {len(b)}; only spark: {extra}; only sql: {missing}; columns {sorted(columns)}"
