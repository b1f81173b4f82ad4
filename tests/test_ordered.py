import random

import pytest
from pyspark.sql import Window, functions as F

from sievelog.operators.ordered import (
    Running, add_quantile_cells, cell_window, drop_halo, positions, running, width_cells, with_halo,
)


def _rows(seed, n=400):
    """Sparse, unevenly filled positions; one group holds most rows, one group is absent (null)."""
    rnd = random.Random(seed)
    out = []
    for g, share in (("hot", n), ("small", 7), ("one", 1), (None, 20)):
        at = 0
        for _ in range(share):
            at += rnd.choice([1, 1, 1, 2, 40])
            out.append((g, at, rnd.randint(-5, 5) if rnd.random() > 0.1 else None))
    return out


@pytest.mark.parametrize("width", [1, 3, 17, 1000])
def test_running_equals_plain_window(spark, width):
    df = spark.createDataFrame(_rows(1), "g string, at bigint, v bigint")
    plain = Window.partitionBy("g").orderBy("at")
    expected = df.select(
        "g", "at",
        F.sum("v").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
        F.max("v").over(plain.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
        F.min("v").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("n"),
        (F.row_number().over(plain) - 1).cast("bigint").alias("p"),
    )
    place, cell = [F.col("at")], width_cells(F.col("at"), width)
    found = running(
        df, ["g"], place, cell,
        {"s": Running("sum", F.col("v")), "m": Running("max", F.col("v"), False), "n": Running("min", F.col("v"))},
    )
    found = positions(found, ["g"], place, cell, "p").select("g", "at", "s", "m", "n", "p")
    assert sorted(found.collect(), key=str) == sorted(expected.collect(), key=str)


@pytest.mark.parametrize("per_cell", [1, 10, 10_000])
def test_quantile_cells_follow_the_order(spark, per_cell):
    rows = [(float(i % 50), i) for i in range(300)] + [(None, 300)]
    df = spark.createDataFrame(rows, "x double, i int")
    out = add_quantile_cells(df, F.col("x"), per_cell).orderBy("x").collect()
    assert [r["cell"] for r in out] == sorted(r["cell"] for r in out)
    by_value = {}
    for r in out:
        by_value.setdefault(r["x"], set()).add(r["cell"])
    assert all(len(c) == 1 for c in by_value.values())


@pytest.mark.parametrize("width", [1, 2, 4, 50])
def test_halo_gives_every_neighbour(spark, width):
    df = spark.createDataFrame(_rows(2), "g string, at bigint, v bigint")
    place = [F.col("at")]
    frame = (-5, 5)
    expected = df.withColumn(
        "n", F.collect_list("at").over(Window.partitionBy("g").orderBy("at").rowsBetween(*frame))
    )
    rows = with_halo(df, ["g"], place, width_cells(F.col("at"), width), 5, 5)
    found = drop_halo(rows.withColumn("n", F.collect_list("at").over(cell_window(place).rowsBetween(*frame))))
    assert sorted(found.collect(), key=str) == sorted(expected.collect(), key=str)


def test_halo_shuffles_rows_once(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").alias("at"))
    place = [F.col("at")]
    rows = with_halo(df, ["g"], place, width_cells(F.col("at"), 10), 1, 1)
    out = drop_halo(rows.withColumn("n", F.lag("at").over(cell_window(place))))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    top = plan[: plan.index("Union")]
    assert "Exchange" not in top


def test_one_and_many_cells_agree_on_nan_infinity_and_null(spark):
    from pyspark.sql import Window

    values = [0.5, float("nan"), None, float("inf"), -float("inf"), 3.0, 0.5, None, float("nan"), -2.0, 7.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values * 3)], "i int, v double")
    order = [F.col("v"), F.col("i")]
    expected = {r.i: r.n for r in df.withColumn("n", F.row_number().over(Window.orderBy(*order)) - 1).collect()}
    for per_cell in (1, 5, 1000):
        celled = add_quantile_cells(df, F.col("v"), per_cell)
        assert {r.i: r.position for r in positions(celled, [], order, F.col("cell")).collect()} == expected
    only = df.where("v is null or isnan(v)")
    assert add_quantile_cells(only, F.col("v"), 2).count() == only.count()


def test_rows_without_a_position_are_kept(spark):
    df = spark.createDataFrame([("f", i if i else None) for i in range(10)], "file string, n long")
    out = positions(df, ["file"], [F.col("n")], width_cells(F.col("n"), 3)).collect()
    assert sorted(r.position for r in out) == list(range(10))
