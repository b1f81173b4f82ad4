"""Connected components by alternating large and small stars, for graphs of any size and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievelog.session import written


def _apart(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the node's least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return _apart(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _apart(moved.unionByName(least.select("a", F.col("m").alias("b"))))


def _state(edges: DataFrame) -> tuple:
    """Number and hash of the edges, to tell whether a round changed any."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of the undirected edges (a, b); the component is its least id.

    Each round reads and writes narrow tables in the shared folder; the number of rounds grows with the square of the
    logarithm of the nodes at worst. Neighbours are only aggregated, never gathered, so a hub of any size is safe.
    """
    now = written(_apart(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))), "edges")
    state = _state(now)
    while state[0]:
        after = written(_small_star(_large_star(now)), "edges")
        now, before, state = after, state, _state(after)
        if state == before:
            break
    # now every node but the least has one edge, to the least
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
