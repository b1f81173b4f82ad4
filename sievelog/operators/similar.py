"""The most similar vectors of many queries, by an inverted file.

All vectors are scaled to unit length and filed under their nearest centroid. The centroids are fitted on at most
``SAMPLE`` distinct vectors, the ones with the smallest hashes; everything else covers all rows. A query visits the
lists of its ``probes`` nearest centroids. Where their number is not given, it is the least that reaches ``recall`` on
``MEASURED`` vectors of the index searched exactly: vectors without clusters need many, others few. With ``exact`` it then visits every further list that can still hold a better
vector: a member's angle to the query is at least the angle to the centroid less the list's widest angle, so lists whose
bound is below the k-th best found are skipped and no vector of the true result is lost.

A list of any length is cut into blocks of about ``BLOCK`` vectors and its queries into blocks of about ``ASKED``; two
blocks meet as two matrices in one task, and each query leaves a block with at most ``k`` rows. Cosines are rounded to
``DIGITS`` places before they are ranked, and ties go to the smaller id, so the result does not depend on the blocks.
Where queries are sent to lists, Python takes ``AT_ONCE`` vectors at a time and hands on at most ``SENT_BYTES`` of copies at
once, so what it holds depends neither on the number of queries nor on that of the lists they visit.

Vectors without length, with a null, infinite or NaN element, or without an id are not filed and find nothing. Repeated
ids are filed each. A query does not find the rows that bear its own id; ids of queries are unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from sievelog.functions.vectors import as_double, norm
from sievelog.operators.lookup import spread_lookup
from sievelog.session import ship_package, written

SAMPLE = 20_000
FIRST_PROBES = 8
MOST_LISTS = 1024
MEASURED, MARGIN = 200, 0.03
BLOCK, ASKED = 4096, 256
AT_ONCE, SENT_BYTES = 1024, 8 << 20
DIGITS = 6


def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors of length one, of the rows that have a direction."""
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), as_double(F.col(vector)).alias("v"))
    # the length is bound before the elements are divided by it, else it would be computed again for each of them
    measured = F.transform(F.array("v"), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    good = F.filter(measured, lambda s: (s["n"] > 0) & (s["n"] < math.inf))
    units = F.transform(good, lambda s: F.transform(s["v"], lambda x: x / s["n"]))
    return rows.select("id", F.explode(units).alias("v"))


def _centroids(units: DataFrame, lists: int | None) -> np.ndarray:
    """Centroids of unit length, fitted on a bounded sample of distinct vectors."""
    hashed = units.withColumn("h", F.xxhash64("v"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(SAMPLE)
    found = chosen.agg(F.max("h").alias("last"), F.count(F.lit(1)).alias("n")).head()
    if not found["n"]:
        return np.zeros((0, 0))
    lists = min(lists or max(1, round(math.sqrt(found["n"]))), MOST_LISTS, found["n"])
    sample = hashed.where(F.col("h") <= found["last"]).dropDuplicates(["h"]).select(array_to_vector("v").alias("features"))
    if lists == 1:  # any direction will do for the only list
        return np.array([sample.head()["features"].toArray()])
    model = KMeans(k=lists, seed=1, maxIter=10, initSteps=1).fit(written(sample, "sample"))
    centres = np.array(model.clusterCenters())
    lengths = np.linalg.norm(centres, axis=1, keepdims=True)
    return centres / np.where(lengths > 0, lengths, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, at most ``AT_ONCE`` at a time and never none."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _angles(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centroids.T, -1, 1))


class SimilarityIndex:
    """Vectors filed by centroid. The table of the lists lies in the shared folder."""

    def __init__(self, df: DataFrame, key: str, vector: str, lists: int | None = None):
        self.spark = df.sparkSession
        ship_package(self.spark)
        units = written(unit_vectors(df, key, vector), "units")  # read three times
        self.id_type = units.schema["id"].dataType
        # at most MOST_LISTS vectors: parameters of the index, sent with the tasks
        self.centroids = _centroids(units, lists)
        filed = self.filed = written(self._filed(units), "filed")
        sizes = filed.groupBy("list").agg(F.count(F.lit(1)).alias("members"), F.max("angle").alias("widest"))
        sizes = sizes.select("list", "members", "widest").collect()  # one row per centroid
        self.sizes = {r["list"]: r["members"] for r in sizes}
        self.widest = np.full(len(self.centroids), -math.inf)
        for r in sizes:
            self.widest[r["list"]] = r["widest"]
        self.blocks = written(self._blocked(filed, BLOCK, self._block_counts()), "blocks")

    def _filed(self, units: DataFrame) -> DataFrame:
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches):
                angles = _angles(_matrix(batch.column("v")), centroids)
                nearest = angles.argmin(1)
                columns = [pa.array(nearest.astype(np.int32)), pa.array(angles.min(1)), batch.column("id"), batch.column("v")]
                yield pa.record_batch(columns, ["list", "angle", "id", "v"])

        return units.mapInArrow(run, _schema(self.id_type, list="int", angle="double", id=None, v="doubles"))

    def _block_counts(self) -> Column:
        """Blocks of each list, as a literal map: one entry per centroid."""
        entries = [F.lit(x) for list_, n in sorted(self.sizes.items()) for x in (list_, -(-n // BLOCK))]
        return F.create_map(*entries)[F.col("list")] if entries else F.lit(1)

    def _blocked(self, filed: DataFrame, size: int, blocks: Column) -> DataFrame:
        """Rows gathered into blocks of about ``size``: never more of a list than its hash puts together."""
        block = F.pmod(F.xxhash64("id"), blocks.cast("bigint")).alias("block")
        rows = filed.select("list", block, "id", "v")
        return rows.groupBy("list", "block").agg(F.collect_list(F.struct("id", "v")).alias("members"))

    def search(
        self,
        queries: DataFrame,
        key: str,
        vector: str,
        k: int = 10,
        probes: int | None = None,
        exact: bool = False,
        recall: float = 0.9,
    ) -> DataFrame:
        """(query, rank, id, similarity) of the ``k`` most similar vectors of each query."""
        asked = written(unit_vectors(queries, key, vector), "asked")
        probes = probes or (FIRST_PROBES if exact else self.probes_for(k, recall))
        return self._search(asked, k, probes, exact).drop("list")

    def probes_for(self, k: int, recall: float) -> int:
        """Lists to visit for this recall, measured on a bounded sample of the index's own vectors."""
        if not len(self.centroids):
            return 1
        hashed = self.filed.select("id", "v", F.xxhash64("v").alias("h")).dropDuplicates(["id"])
        sample = written(hashed.orderBy("h", "id").limit(MEASURED).select("id", "v"), "measured")
        found = self._search(sample, k, FIRST_PROBES, True).select(F.col("query").alias("id"), "list")
        rows = found.join(sample, "id").collect()  # at most MEASURED * k
        if not rows:
            return 1
        angles = _angles(np.array([r["v"] for r in rows]), self.centroids)
        own = angles[np.arange(len(rows)), [r["list"] for r in rows]]
        nearer = np.sort((angles < own[:, None]).sum(1))
        return int(nearer[min(len(rows) - 1, math.ceil(min(1.0, recall + MARGIN) * len(rows)))]) + 1

    def _search(self, asked: DataFrame, k: int, probes: int, exact: bool) -> DataFrame:
        first = self._visit(self._routed(asked, probes), k)
        if exact:
            first = written(first, "first")
            worst = F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("worst")
            reached = first.groupBy(F.col("query").alias("id")).agg(worst)
            more = self._visit(self._routed(asked.join(reached, "id", "left"), probes, further=True), k)
            first = _best(first.drop("rank").unionByName(more.drop("rank")), k)
        return first

    def _routed(self, asked: DataFrame, probes: int, further: bool = False) -> DataFrame:
        """(list, id, v): each query with the lists it visits, the nearest or all further ones that its bound allows."""
        centroids, widest = self.centroids, self.widest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _slices(batches if len(centroids) else ()):
                angles = _angles(_matrix(batch.column("v")), centroids)
                near = np.zeros(angles.shape, bool)
                np.put_along_axis(near, np.argsort(angles, axis=1, kind="stable")[:, :probes], True, axis=1)
                if further:
                    worst = np.array([-2.0 if w is None else w for w in batch.column("worst").to_pylist()])
                    best = np.cos(np.clip(angles - widest, 0, math.pi))
                    near = ~near & (best >= worst[:, None] - 10.0 ** (1 - DIGITS))
                near &= widest >= 0
                rows, lists = np.nonzero(near)
                step = max(1, SENT_BYTES // (8 * centroids.shape[1]))
                for at in range(0, len(rows), step):
                    row, list_ = pa.array(rows[at : at + step]), lists[at : at + step].astype(np.int32)
                    columns = [pa.array(list_), batch.column("id").take(row), batch.column("v").take(row)]
                    yield pa.record_batch(columns, ["list", "id", "v"])

        return asked.mapInArrow(run, _schema(self.id_type, list="int", id=None, v="doubles"))

    def _visit(self, routed: DataFrame, k: int) -> DataFrame:
        """The best rows of each query in the lists it visits."""
        routed = written(routed, "routed")
        sizes = routed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(ASKED)).alias("parts"))
        cut = spread_lookup(routed, ["list"], sizes, ["id"])
        part = F.pmod(F.xxhash64("id"), F.col("parts")).alias("part")
        asking = cut.select("list", part, "id", "v").groupBy("list", "part").agg(F.collect_list(F.struct("id", "v")).alias("asking"))
        met = self.blocks.join(asking, "list").select("members", "asking", "list")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    members, asking = (batch.column(c)[row].values for c in (0, 1))
                    ids, queries = members.field("id"), asking.field("id")
                    order = pa.array(np.argsort(np.array(ids.to_pylist(), object), kind="stable"))
                    ids, vectors = ids.take(order), _matrix(members.field("v").take(order))
                    steps = np.rint(_matrix(asking.field("v")) @ vectors.T * 10**DIGITS).astype(np.int64)
                    own = {q: [] for q in queries.to_pylist()}
                    for i, x in enumerate(ids.to_pylist()):
                        if x in own:
                            own[x].append(i)
                    # one number for cosine and place: the least are the best, ties by id
                    n = len(ids)
                    ranked = np.arange(n) - steps * n
                    wide = min(n, k + max(map(len, own.values())))
                    take = np.argpartition(ranked, wide - 1, axis=1)[:, :wide]
                    take = np.take_along_axis(take, np.take_along_axis(ranked, take, 1).argsort(1), 1)
                    out_q, out_i = [], []
                    for q, x in enumerate(queries.to_pylist()):
                        found = take[q][~np.isin(take[q], own[x])][:k]
                        out_q += [q] * len(found)
                        out_i += found.tolist()
                    cosines = steps[out_q, out_i] / 10**DIGITS
                    columns = [queries.take(pa.array(out_q, pa.int64())), ids.take(pa.array(out_i, pa.int64()))]
                    columns += [pa.array(cosines, pa.float64()), batch.column("list").take(pa.array([row] * len(out_q), pa.int64()))]
                    yield pa.record_batch(columns, ["query", "id", "similarity", "list"])

        return _best(met.mapInArrow(run, _schema(self.id_type, query=None, id=None, similarity="double", list="int")), k)


def _schema(id_type: T.DataType, **columns) -> T.StructType:
    kinds = {None: id_type, "int": T.IntegerType(), "double": T.DoubleType(), "doubles": T.ArrayType(T.DoubleType())}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in columns.items()])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each query; the limit is also applied before rows are shuffled."""
    by_query = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query", "rank", "id", "similarity", "list")


def similar(
    df: DataFrame,
    queries: DataFrame,
    key: str,
    vector: str = "embedding",
    k: int = 10,
    probes: int | None = None,
    exact: bool = False,
    lists: int | None = None,
    recall: float = 0.9,
) -> DataFrame:
    """The ``k`` rows of ``df`` most similar to each row of ``queries``: (query, rank, id, similarity)."""
    return SimilarityIndex(df, key, vector, lists).search(queries, key, vector, k, probes, exact, recall)
