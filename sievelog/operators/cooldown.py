"""Cooldown: drop an alert whose identity was *sent* less than its cooldown ago.

The rule looks at the last alert that went out, not at the last one seen, so it is a walk along each identity's times.
An identity of up to ``rows_per_cell`` times is one cell and is walked inside its row with array functions. A longer one
is cut into cells by time. What happens in a cell depends on one number, the time last sent before it, so each cell
becomes a map from that time to the time last sent after it: a list of bounds, each with the time that is last sent when
the cell is entered up to that bound. Maps of neighbouring cells are composed, over twice as many cells in each round,
until every cell knows the time it is entered with; then all cells are walked at once.

The number of jobs grows with the logarithm of the number of cells, which the session bounds, and not with the alerts
sent. A cell is only entered with times before its own, so a map has no more bounds than there are alerts in the one
cooldown after its start, however many cells it covers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sievelog.operators.lookup import spread_lookup
from sievelog.operators.ordered import ROWS_PER_CELL, add_quantile_cells
from sievelog.session import ship_package, written


def apply_cooldown(
    alerts: DataFrame,
    key: str = "id",
    ts: str = "ts",
    order: str = "line_no",
    cooldown: str | int = "cooldown",
    rows_per_cell: int = ROWS_PER_CELL,
    sent_before: DataFrame | None = None,
) -> DataFrame:
    """Keep the alerts that are sent. ``order`` is unique in an identity (a row number, or a struct of
    file and row number) and also breaks ties in time.

    ``sent_before`` holds the last time each identity (columns ``key`` and ``ts``) was sent by an earlier run;
    alerts up to a cooldown after it, and late ones before it, are held back.
    """
    seconds = F.col(cooldown) if isinstance(cooldown, str) else F.lit(cooldown)
    narrow = alerts.select(
        F.col(key).alias("k"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("t"),
        (seconds.cast("bigint") * 1_000_000).alias("c"),
        F.col(order).alias("o"),
    ).where("k is not null and t is not null and c is not null")
    # of equal times under an equal cooldown only the first can be sent
    steps = narrow.groupBy("k", "t", "c").agg(F.min("o").alias("o"))
    # an earlier run's time comes first whatever its value
    steps = steps.withColumn("s", F.lit(1))
    if sent_before is not None:
        earlier = sent_before.select(
            F.col(key).alias("k"),
            F.unix_micros(F.col(ts).cast("timestamp")).alias("t"),
            F.lit(0).cast("bigint").alias("c"),
            F.lit(None).cast(alerts.schema[order].dataType).alias("o"),
            F.lit(0).alias("s"),
        )
        steps = steps.unionByName(earlier)

    sizes = steps.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_cell)
    long = written(sizes.select("k", F.lit(True).alias("long")), "long")
    if long.isEmpty():
        kept = _walk_rows(steps)
    else:
        # found where the rows are: a long identity has its rows spread over all parts
        steps = written(spread_lookup(steps, ["k"], long, ["t", "c"]), "steps")
        kept = _walk_rows(steps.where("long is null")).unionByName(_walk_cells(steps.where("long"), rows_per_cell))
    # without a cooldown nothing is held back, equal times included
    free = narrow.where("c <= 0").select("k", "o")
    kept = kept.where("o is not null").unionByName(free).distinct()
    return alerts.join(
        kept.select(F.col("k").alias(key), F.col("o").alias(order)), [key, order], "left_semi"
    )


def _walk_rows(steps: DataFrame) -> DataFrame:
    """Walk the sorted times of each identity inside its row."""
    timeline = F.sort_array(F.collect_list(F.struct("s", "t", "o", "c")))
    none_yet = F.array().cast(T.ArrayType(steps.schema["o"].dataType))
    start = F.struct(F.lit(None).cast("bigint").alias("last"), none_yet.alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        goes = acc["last"].isNull() | (x["t"] - acc["last"] >= x["c"])
        return F.struct(
            F.when(goes, F.greatest(acc["last"], x["t"])).otherwise(acc["last"]).alias("last"),
            F.when(goes, F.array_append(acc["kept"], x["o"])).otherwise(acc["kept"]).alias("kept"),
        )

    walked = steps.groupBy("k").agg(timeline.alias("steps"))
    return walked.select(
        "k", F.explode(F.aggregate("steps", start, step, lambda acc: acc["kept"])).alias("o")
    )


class Cell:
    """A stretch of one identity's times, in order, and the alerts that can go out in it."""

    def __init__(self, t: np.ndarray, wait: np.ndarray):
        self.t = t
        # an alert goes if the last one sent is not after this; one without a cooldown always goes, and is kept apart
        self._latest = np.maximum.accumulate(np.where(wait > 0, t - wait, t - 1))
        self._next = np.searchsorted(self._latest, t)

    def sent(self, last: int | None) -> list[int]:
        """Places of the alerts sent when entered with this time last sent."""
        at = 0 if last is None else int(np.searchsorted(self._latest, last))
        out = []
        while at < len(self.t):
            out.append(at)
            at = int(self._next[at])
        return out

    def exits(self) -> tuple[np.ndarray, np.ndarray]:
        """The map: (bounds, times). Entered up to a bound, the time beside it is last sent; after all bounds nothing is."""
        n = len(self.t)
        inside = self._next < n
        end = np.where(inside, np.minimum(self._next, n - 1), np.arange(n))
        while True:  # each step follows twice as many alerts
            further = end[end]
            if np.array_equal(further, end):
                break
            end = further
        new = np.flatnonzero(np.diff(self._latest, prepend=self._latest[0] - 1))
        return shortened(self._latest[new], self.t[end[new]], int(self.t[0]))


def shortened(bounds: np.ndarray, times: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """A map without the bounds that no time before ``first`` needs; of neighbours with the same time the last stays."""
    used = int(np.searchsorted(bounds, first - 1)) + 1
    bounds, times = bounds[:used], times[:used]
    last = np.append(times[1:] != times[:-1], [True])[: len(times)]
    return bounds[last], times[last]


def composed(
    bounds: np.ndarray, times: np.ndarray, after_bounds: np.ndarray, after_times: np.ndarray, first: int
) -> tuple[np.ndarray, np.ndarray]:
    """The map of two stretches that follow each other, the earlier one from ``first`` on."""
    at = np.minimum(np.searchsorted(after_bounds, times), len(after_bounds) - 1)
    through = np.where(times <= after_bounds[at], after_times[at], times)
    beyond = after_bounds > bounds[-1]
    return shortened(np.concatenate([bounds, after_bounds[beyond]]), np.concatenate([through, after_times[beyond]]), first)


def _walk_cells(steps: DataFrame, rows_per_cell: int) -> DataFrame:
    """Walk identities of any length, all their cells at once."""
    ship_package(steps.sparkSession)
    before = steps.where("s = 0").groupBy("k").agg(F.max("t").alias("before"))
    rows = spread_lookup(steps.where("s = 1").select("k", "t", "o", "c"), ["k"], before, ["t", "c"])
    held = (F.col("c") > 0) & (F.col("t") - F.col("before") < F.col("c"))
    rows = add_quantile_cells(rows.where(~F.coalesce(held, F.lit(False))).drop("before"), F.col("t"), rows_per_cell)
    # place in the cell, so that ties in time keep the order whatever its type
    inside = Window.partitionBy("k", "cell").orderBy("t", "o")
    rows = written(rows.withColumn("place", F.row_number().over(inside)), "cells")
    key = T.StructType([rows.schema["k"], rows.schema["cell"]])

    def to_map(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        bounds, times = Cell(table["t"].to_numpy(), table["c"].to_numpy()).exits()
        lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (bounds, times)]
        return pa.table([*(table[c].slice(0, 1) for c in ("k", "cell", "t")), *lists], ["k", "cell", "first", "bounds", "times"])

    longs = T.ArrayType(T.LongType())
    map_schema = T.StructType(key.fields).add("first", "long").add("bounds", longs).add("times", longs)
    maps = rows.select("k", "cell", "t", "c", "place").groupBy("k", "cell").applyInArrow(to_map, map_schema)
    number = F.row_number().over(Window.partitionBy("k").orderBy("cell"))
    maps = written(maps.withColumn("number", number), "maps")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            names = ["earlier_bounds", "earlier_times", "bounds", "times"]
            for row in batch.select([*names, "earlier_first", "first"]).to_pylist():
                if row["earlier_first"] is None:
                    out.append((row["first"], row["bounds"], row["times"]))
                else:
                    made = composed(*(np.array(row[x], np.int64) for x in names), row["earlier_first"])
                    out.append((row["earlier_first"], *(x.tolist() for x in made)))
            first = pa.array([r[0] for r in out], pa.int64())
            lists = [pa.array([r[i] for r in out], pa.list_(pa.int64())) for i in (1, 2)]
            yield pa.record_batch([*(batch.column(c) for c in ("k", "cell", "number")), first, *lists], maps_names)

    maps_names = ["k", "cell", "number", "first", "bounds", "times"]
    maps = maps.select(maps_names)
    most, reach = maps.agg(F.max("number")).head()[0], 1
    while reach < most:
        renamed = [F.col(x).alias(f"earlier_{x}") for x in ("first", "bounds", "times")]
        earlier = maps.select("k", (F.col("number") + reach).alias("number"), *renamed)
        maps = written(maps.join(earlier, ["k", "number"], "left").mapInArrow(compose, maps.schema), "maps")
        reach *= 2

    # nothing was sent before the first cell; every other is entered with what the stretch before it makes of that
    entered = maps.select("k", (F.col("number") + 1).alias("number"), F.col("times")[0].alias("last"))
    cells = maps.select("k", "cell", "number").join(entered, ["k", "number"], "left").select("k", "cell", "last")

    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        last = table["last"][0].as_py()
        places = Cell(table["t"].to_numpy(), table["c"].to_numpy()).sent(last)
        return table.select(["k", "o"]).take(pa.array(places, pa.int64()))

    walked = rows.join(cells, ["k", "cell"]).select("k", "cell", "t", "c", "o", "place", "last")
    return walked.groupBy("k", "cell").applyInArrow(walk, T.StructType([rows.schema["k"], rows.schema["o"]]))
