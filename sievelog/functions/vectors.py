"""Statistics and similarity of ``ARRAY<FLOAT>`` vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(as_double(vector), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null when either vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def mean(vector: Column) -> Column:
    return _sum(as_double(vector)) / F.size(vector)


def std(vector: Column, centre: Column) -> Column:
    """Population standard deviation around ``centre``, which the caller has already projected."""
    squares = F.transform(as_double(vector), lambda x: (x - centre) * (x - centre))
    return F.sqrt(_sum(squares) / F.size(vector))


def with_statistics(df, column: str):
    """Add norm, mean, population deviation, maximum and minimum of the vector in ``column``."""
    v = F.col(column)
    return df.withColumn("embedding_mean", mean(v)).withColumns(
        {
            "embedding_norm": norm(v),
            "embedding_std": std(v, F.col("embedding_mean")),
            "embedding_max": F.array_max(as_double(v)),
            "embedding_min": F.array_min(as_double(v)),
        }
    )
