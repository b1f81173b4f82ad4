"""Features of an entry's neighbourhood: five entries on each side, in file order.

Files are cut into cells with five-row halos (see :mod:`sievelog.operators.ordered`), so a file of any size is
spread over the cluster. Similarities are computed once per pair: the value an entry has with the one ``k``
places before it is read by that earlier entry with ``lead``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievelog.functions.text import words
from sievelog.operators.ordered import (
    ROWS_PER_CELL,
    cell_window,
    drop_halo,
    positions,
    whole_division,
    width_cells,
    with_halo,
)

REACH = 5
CONTEXT_COLUMNS = (
    "avg_time_delta",
    "std_time_delta",
    "max_time_delta",
    "error_ratio_in_window",
    "warn_ratio_in_window",
    "unique_sources_in_window",
    "avg_similarity_in_window",
    "max_similarity_in_window",
)
_ENTRY_FIELDS = ("ts", "level", "source", "message", "raw_log", "metadata")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct words; null when both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either)


def context_features(
    df: DataFrame,
    group: Sequence[str] = ("file",),
    order: str = "line_no",
    columns: Sequence[str] = CONTEXT_COLUMNS,
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Append the requested neighbourhood columns.

    ``order`` must be a unique integer position inside ``group``. Entries alone in their group get nulls.
    """
    place = [F.col(order)]
    rows = with_halo(df, group, place, width_cells(F.col(order), rows_per_cell), REACH, REACH)
    ordered = cell_window(place)
    around = ordered.rowsBetween(-REACH, REACH)
    company = F.count(F.lit(1)).over(around) > 1
    out: dict[str, Column] = {}

    if any("time_delta" in c for c in columns):
        # null times are left out before differencing; so the list is taken first
        rows = rows.withColumn("_times", F.collect_list(F.unix_micros(F.col("ts"))).over(around))
        times = F.col("_times")
        n = F.size(times)
        gaps = F.when(
            n > 1,
            F.zip_with(F.slice(times, 2, n - 1), F.slice(times, 1, n - 1), lambda b, a: b - a),
        )
        rows = rows.withColumn("_gaps", gaps)
        gaps = F.col("_gaps")
        # whole microseconds until the end: sums are exact
        total = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
        rows = rows.withColumn("_mean_gap", total / F.size(gaps))
        centre = F.col("_mean_gap")
        spread = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + (x - centre) * (x - centre))
        out["avg_time_delta"] = centre / 1e6
        out["std_time_delta"] = F.sqrt(spread / F.size(gaps)) / 1e6
        out["max_time_delta"] = F.array_max(gaps) / 1e6

    if any("ratio_in_window" in c for c in columns):
        for name, level in (("error_ratio_in_window", "ERROR"), ("warn_ratio_in_window", "WARN")):
            hit = F.coalesce(F.col("level") == level, F.lit(False)).cast("int")
            out[name] = F.when(company, F.avg(hit).over(around))

    if "unique_sources_in_window" in columns:
        # an absent source is a value of its own
        seen = F.collect_set(F.struct("source")).over(around)
        out["unique_sources_in_window"] = F.when(company, F.size(seen))

    if any("similarity_in_window" in c for c in columns):
        rows = _pair_similarities(rows, ordered)
        found = F.array_compact(
            F.array(
                *[F.col(f"_sim_{k}") for k in range(1, REACH + 1)],
                *[F.lead(f"_sim_{k}", k).over(ordered) for k in range(1, REACH + 1)],
            )
        )
        rows = rows.withColumn("_found", found)
        found = F.col("_found")
        summed = F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x)
        out["avg_similarity_in_window"] = F.when(F.size(found) > 0, summed / F.size(found))
        out["max_similarity_in_window"] = F.array_max(found)

    return drop_halo(rows.withColumns(out)).select(*df.columns, *columns)


def _pair_similarities(rows: DataFrame, ordered) -> DataFrame:
    """``_sim_k``: similarity with the entry ``k`` places before; null where that entry is equal in all fields."""
    fields = [F.col(c) for c in _ENTRY_FIELDS if c in rows.columns]
    distinct = F.array_distinct(words(F.lower(F.col("message"))))
    # what an earlier entry hands down: its words and a short digest standing for all its fields
    rows = rows.withColumn("_words", distinct).withColumn("_self", F.struct("_words", _digest(fields).alias("id")))
    rows = rows.withColumns({f"_back_{k}": F.lag("_self", k).over(ordered) for k in range(1, REACH + 1)})
    return rows.withColumns(
        {
            f"_sim_{k}": F.when(
                F.col(f"_back_{k}.id") != F.col("_self.id"),
                jaccard(F.col("_words"), F.col(f"_back_{k}._words")),
            )
            for k in range(1, REACH + 1)
        }
    ).drop("_self", "_words", *[f"_back_{k}" for k in range(1, REACH + 1)])


def _digest(fields: Sequence[Column]) -> Column:
    """128 bits over the fields; absent fields are marked because the hashes skip nulls."""
    marked = [*fields, *[f.isNull() for f in fields]]
    return F.struct(F.xxhash64(*marked), F.xxhash64(F.lit(1), *reversed(marked)))


def entry_index(
    df: DataFrame,
    group: Sequence[str] = ("file",),
    order: str = "line_no",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Zero-based position of each entry in its file."""
    cell = width_cells(F.col(order), rows_per_cell)
    return positions(df, group, [F.col(order)], cell, "entry_index")


def chunk_counts(
    df: DataFrame,
    size: int,
    group: Sequence[str] = ("file",),
    order: str = "line_no",
    flag: str = "is_anomaly",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Rows and anomalies of each consecutive batch of ``size`` entries."""
    indexed = entry_index(df, group, order, rows_per_cell)
    batch = whole_division(F.col("entry_index"), size).alias("batch")
    return indexed.groupBy(*group, batch).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col(flag).cast("int")).alias("anomalies")
    )
