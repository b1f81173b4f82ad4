import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sievelog.operators import similar as S
from sievelog.operators.similar import SimilarityIndex, similar

KIND = "id bigint, embedding array<float>"


def _clustered(n, dim=16, clusters=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    return [(i, [float(x) for x in np.float32(centres[rng.integers(clusters)] + 0.4 * rng.normal(size=dim))]) for i in range(n)]


def brute(rows, asked, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = []
    for q in asked:
        for _, v in [r for r in good if r[0] == q]:
            near = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), S.DIGITS), i) for i, w in good if i != q]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(near)[:k])]
    return sorted(out)


def rows_of(df):
    return sorted((r["query"], r["rank"], r["id"], round(r["similarity"], S.DIGITS)) for r in df.collect())


@pytest.mark.parametrize("block", [4096, 40])
def test_exact_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "ASKED", block // 10)
    rows = _clustered(900)
    rows += [(2000 + i, rows[5][1]) for i in range(60)]  # copies tie
    df = spark.createDataFrame(rows, KIND)
    found = similar(df, df.where("id % 100 = 0"), "id", k=7, probes=1, exact=True)
    assert rows_of(found) == brute(rows, [i for i, _ in rows if i % 100 == 0], 7)


def test_recall_of_probed_lists(spark):
    rows = _clustered(4000, dim=24, clusters=60)
    df = spark.createDataFrame(rows, KIND)
    asked = df.where("id % 100 = 0")
    index = SimilarityIndex(df, "id", "embedding")
    true = {(q, i) for q, _, i, _ in rows_of(index.search(asked, "id", "embedding", exact=True))}
    found = {(q, i) for q, _, i, _ in rows_of(index.search(asked, "id", "embedding"))}
    assert len(true) == 400 and len(found & true) / len(true) >= 0.9
    assert len(index.centroids) > 40 and sum(index.sizes.values()) == 4000


def test_recall_on_the_given_vectors(spark):
    import os

    from tests.oracle import ROOT
    from sievelog.plans.features import QUERIES

    if not os.path.isdir(f"{ROOT}/sf0.01"):
        pytest.skip("test tables not present")
    true = {(q, i) for q, _, i, _ in rows_of(QUERIES["top_similar"](spark, f"{ROOT}/sf0.01"))}
    found = {(q, i) for q, _, i, _ in rows_of(QUERIES["top_similar_probed"](spark, f"{ROOT}/sf0.01"))}
    assert len(found & true) / len(true) >= 0.9


def test_awkward_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (None, [1.0, 1.0]), (4, [float("nan"), 1.0]), (5, [2.0, 0.0]), (6, [-1.0, 0.0]),
            (7, [float("inf"), 1.0]), (8, [None, 1.0]), (1, [1.0, 0.1])]
    df = spark.createDataFrame(rows, KIND)
    found = rows_of(similar(df, df.where("id > 1 or id is null"), "id", k=3, exact=True))
    assert found == brute(rows, [5, 6], 3)
    empty = df.limit(0)
    assert similar(empty, df, "id").count() == 0 and similar(df.where("id = 5"), df.where("id > 1"), "id").count() == 1 and similar(df, empty, "id", exact=True).count() == 0


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3), st.integers(-3, 3)), min_size=1, max_size=25), st.integers(1, 6), st.integers(1, 4))
def test_any_small_set(spark, vectors, k, lists):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, KIND)
    found = similar(df, df, "id", k=k, probes=1, exact=True, lists=lists)
    assert rows_of(found) == brute(rows, range(len(rows)), k)


def test_routed_queries_leave_in_bounded_batches():
    import pyarrow as pa
    from pyspark.sql import types as T

    class Asked:
        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(5)
    n, lists, dim = 5000, 100, 64
    vectors = rng.normal(size=(n, dim))
    index = SimilarityIndex.__new__(SimilarityIndex)
    index.id_type = T.LongType()
    index.centroids = rng.normal(size=(lists, dim))
    index.centroids /= np.linalg.norm(index.centroids, axis=1, keepdims=True)
    index.widest = np.full(lists, np.pi)
    columns = [pa.array(range(n)), pa.array(list(vectors)), pa.array([None] * n, pa.float64())]
    run = index._routed(Asked(), 1, further=True)
    sizes, lists_of = [], np.zeros(n, int)
    for batch in run(iter([pa.record_batch(columns, ["id", "v", "worst"])])):
        sizes.append(batch.num_rows * dim * 8)
        ids = batch.column("id").to_numpy()
        np.add.at(lists_of, ids, 1)
        assert np.array_equal(np.array(batch.column("v").to_pylist()[0]), vectors[ids[0]])
    # every list but the nearest, for every query
    assert max(sizes) <= S.SENT_BYTES and (lists_of == lists - 1).all()
