"""Ordered work inside groups of any size.

A window partitioned by source, file or address puts a whole group on one task, and one group may hold a third
of the table. Here a group is cut into *cells*: consecutive stretches of its order. Rows meet only inside their
cell; what a cell needs from its neighbours is a running total (:func:`running`) or a few edge rows
(:func:`with_halo`), both taken from small per-cell tables. The results equal those of the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_CELL = 1 << 15
CELLS_PER_PARTITION = 4

_KEY, _CELL = "_key", "_cell"


def whole_division(value: Column, by: int) -> Column:
    """Integer division; exact for positions beyond the precision of a double."""
    return F.call_function("div", value, F.lit(by).cast("bigint"))


def width_cells(position: Column, width: int = ROWS_PER_CELL) -> Column:
    """Cell of a unique integer position: at most ``width`` rows fall into one."""
    return whole_division(position, width)


def add_quantile_cells(
    df: DataFrame, order: Column, rows_per_cell: int = ROWS_PER_CELL, name: str = "cell"
) -> DataFrame:
    """Add the cell of an order value with unknown spread (times, scores), from the table's own quantiles.

    One narrow job measures the count, a second one the cut points. There are at most ``CELLS_PER_PARTITION`` cells
    for each shuffle partition, so the cut points are bounded by the session and not by the rows; a cell of more
    rows is only longer, its windows stream. Every size takes the same path: nulls sort first, NaN last. Accuracy of
    the quantiles only affects balance. A group's share of one cell is never above the table's share.
    """
    value = order.cast("double")
    n = df.select(value.alias("v")).where("v is not null").count()
    most = CELLS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(most, max(2, -(-n // rows_per_cell)))
    shares = [i / parts for i in range(1, parts)]
    found = df.select(F.percentile_approx(F.nanvl(value, F.lit(math.inf)), shares, 10_000 + 10 * parts).alias("cuts"))
    cuts = sorted({c for c in found.head()["cuts"] or [] if math.isfinite(c)})
    if not cuts:
        # no finite value to cut at; any cut keeps the order
        cuts = [0.0]
    # NaN is put behind infinity by the bucketizer
    bucketizer = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol="_order_value", outputCol="_order_cell", handleInvalid="keep"
    )
    keyed = df.withColumn("_order_value", F.coalesce(value, F.lit(-math.inf)))
    placed = bucketizer.transform(keyed)
    return placed.withColumn(name, F.col("_order_cell").cast("bigint")).drop(
        "_order_value", "_order_cell"
    )


@dataclass(frozen=True)
class Running:
    """A running ``sum``, ``max`` or ``min`` of ``value``; over the earlier rows only when not ``inclusive``."""

    kind: str
    value: Column
    inclusive: bool = True


_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind == "sum":
        return F.when(
            before.isNotNull() | here.isNotNull(),
            F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
        )
    return (F.greatest if kind == "max" else F.least)(before, here)


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    cell: Column,
    measures: Mapping[str, Running],
) -> DataFrame:
    """Append running measures over ``group`` in ``order``.

    ``cell`` must not decrease along ``order``. Per-cell totals are partial-aggregated before they move, their
    running form is a window over one row per cell, and the join back is on the partitioning the rows have.
    """
    # rows without an order value have a cell of their own before all others
    here = F.coalesce(cell, F.lit(-1).cast("bigint"))
    keyed = df.withColumns({_KEY: F.struct(*group) if group else F.struct(F.lit(0)), _CELL: here})
    keyed = keyed.withColumns({f"_v_{name}": m.value for name, m in measures.items()})
    values = [f"_v_{name}" for name in measures]

    totals = keyed.groupBy(_KEY, _CELL).agg(
        *[_AGGREGATE[m.kind](f"_v_{name}").alias(f"_t_{name}") for name, m in measures.items()]
    )
    earlier = Window.partitionBy(_KEY).orderBy(_CELL).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _KEY,
        _CELL,
        *[_AGGREGATE[m.kind](f"_t_{name}").over(earlier).alias(f"_o_{name}") for name, m in measures.items()],
    )

    inside = Window.partitionBy(_KEY, _CELL).orderBy(*order)
    local = keyed.select(
        "*",
        *[
            _AGGREGATE[m.kind](f"_v_{name}")
            .over(inside.rowsBetween(Window.unboundedPreceding, 0 if m.inclusive else -1))
            .alias(f"_l_{name}")
            for name, m in measures.items()
        ],
    )
    joined = local.join(offsets, [_KEY, _CELL])
    out = joined.withColumns(
        {
            name: _combine(m.kind, F.col(f"_o_{name}"), F.col(f"_l_{name}"))
            for name, m in measures.items()
        }
    )
    return out.drop(
        _KEY, _CELL, *values, *[f"_o_{n}" for n in measures], *[f"_l_{n}" for n in measures]
    )


def positions(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], cell: Column, name: str = "position"
) -> DataFrame:
    """Zero-based, gapless position of each row in its group; ``order`` must be unique."""
    one = {name: Running("sum", F.lit(1).cast("bigint"), inclusive=False)}
    return running(df, group, order, cell, one).withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def with_halo(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    cell: Column,
    before: int,
    after: int,
) -> DataFrame:
    """Rows keyed by ``(_key, _cell)``, with copies of the ``before``/``after`` rows around each cell.

    Copies carry ``_halo = true``; windows over ``(_key, _cell)`` in ``order`` see the same neighbours a window
    over the whole group would, and the copies are filtered out afterwards. A cell may be shorter than the
    halo, in which case the copies come from several cells further on.

    The rows are shuffled once, by cell: the edge rows are read from the same exchange as the rows themselves.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a cell that cannot be null keeps the joins below from adding a null filter to one reader of the exchange
    keyed = df.withColumns({_KEY: F.struct(*group), _CELL: F.coalesce(cell, F.lit(-1).cast("bigint"))})
    placed = keyed.repartition(parts, _KEY, _CELL)

    counts = keyed.groupBy(_KEY, _CELL).agg(F.count(F.lit(1)).alias("_n"))
    by_cell = Window.partitionBy(_KEY).orderBy(_CELL)

    def neighbours(side: str, reach: int, shift) -> list[Column]:
        out, gathered = [], F.lit(0)
        for k in range(1, reach + 1):
            here = F.coalesce(shift("_n", k).over(by_cell), F.lit(0))
            missing = F.lit(reach) - gathered
            out.append(
                F.when(
                    (missing > 0) & (here > 0),
                    F.struct(
                        shift(_CELL, k).over(by_cell).alias("src"),
                        F.lit(side).alias("side"),
                        missing.cast("bigint").alias("want"),
                    ),
                )
            )
            gathered = gathered + here
        return out

    wanted = neighbours("before", before, F.lag) + neighbours("after", after, F.lead)
    links = counts.select(_KEY, F.col(_CELL).alias("_dst"), F.array_compact(F.array(*wanted)).alias("_ws"))
    links = links.select(_KEY, "_dst", F.explode("_ws").alias("_w")).select(_KEY, F.col("_w.src").alias(_CELL), "_dst", "_w.side", "_w.want")

    inside = Window.partitionBy(_KEY, _CELL)
    edges = (
        placed.withColumns(
            {
                "_rn": F.row_number().over(inside.orderBy(*order)),
                "_n": F.count(F.lit(1)).over(inside),
            }
        )
        .where((F.col("_rn") <= after) | (F.col("_rn") > F.col("_n") - before))
    )
    halo = (
        edges.join(links, [_KEY, _CELL])
        .where(
            ((F.col("side") == "before") & (F.col("_rn") > F.col("_n") - F.col("want")))
            | ((F.col("side") == "after") & (F.col("_rn") <= F.col("want")))
        )
        .drop(_CELL)
        .withColumnRenamed("_dst", _CELL)
        .select(*df.columns, _KEY, _CELL, F.lit(True).alias("_halo"))
        .repartition(parts, _KEY, _CELL)
    )
    return placed.withColumn("_halo", F.lit(False)).unionByName(halo)


def cell_window(order: Sequence[Column]):
    """Window over one cell of :func:`with_halo`, in ``order``."""
    return Window.partitionBy(_KEY, _CELL).orderBy(*order)


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where("not _halo").drop(_KEY, _CELL, "_halo")
