import os

import pytest

import corpus_pipeline as C
from sievelog.llm import queries
from tests.oracle import ROOT, compare, connect

SF = os.path.join(ROOT, "sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


def test_stages_keep_columns_and_take_effect(spark, documents, nothing, tmp_path):
    from tests.llm.conftest import BASE

    spark.createDataFrame([(1, BASE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [f"{w} {BASE} number {i} of a kind that is long enough to differ" for i, w in enumerate("ab")]
    clean = [" ".join(f"{w}{i}x{k}" for k in range(30) for w in ("mo", "li")) for i in range(6)]
    rows = [(100 + i, t, "en", "s", len(t)) for i, t in enumerate([*texts, *clean, clean[0]])]
    docs = documents.unionByName(spark.createDataFrame(rows, documents.schema))
    stages = dict(C.STAGES)
    kept = stages["language_id"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {0, 1, 2} and ids >= {r[0] for r in rows}
    cleaned = stages["line_dedup"](spark, kept, str(tmp_path))
    # 4, 6 and 7 are the same line, which 7 alone keeps; documents left without a word go, and no others
    assert cleaned.columns == docs.columns
    assert {r.doc_id for r in cleaned.collect()} == {r.doc_id for r in kept.collect()} - {4, 6}
    assert all(r.n_chars == len(r.text) for r in cleaned.collect())
    single = stages["near_duplicates"](spark, cleaned, str(tmp_path))
    ids = {r.doc_id for r in single.collect()}
    assert single.columns == docs.columns and 5 in ids and not ids & {7, 108} and ids >= set(range(102, 108))
    free = stages["decontaminate"](spark, single, str(tmp_path))
    assert free.columns == docs.columns
    ids = {r.doc_id for r in free.collect()}
    assert not ids & {5, 100, 101} and ids >= set(range(102, 108))
    packed = stages["pack"](spark, free, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids
    empty = nothing
    for name, stage in C.STAGES:
        empty = C.written(stage(spark, empty, str(tmp_path)), name)
    assert empty.count() == 0


def test_line_dedup_keeps_documents_that_had_no_words(spark, documents, tmp_path):
    stage = dict(C.STAGES)["line_dedup"]
    kept = [r.doc_id for r in stage(spark, documents, str(tmp_path)).collect()]
    assert {0, 1, 2} <= set(kept) and kept.count(13) == 2 and kept.count(None) == 2


def test_extra_columns_travel_along(spark, clashing, tmp_path):
    spark.createDataFrame([(1, "nothing that occurs")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clashing
    for name, stage in C.STAGES[:-1]:
        docs = C.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == clashing.columns and docs.where("row <> 'clash' or token <> 'clash'").count() == 0
    assert docs.count() > 0
