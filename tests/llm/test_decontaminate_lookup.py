"""Where the windows are few every run of a document is looked up, and no marks are computed for documents."""

import random

from sievelog.llm import decontaminate as dc


def _data(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefg") * rnd.randint(1, 2)
    items = [(f"i{k}", " ".join(word() for _ in range(rnd.choice([4, 10, 14, 30])))) for k in range(30)] + [("none", None)]
    docs = [(k, " ".join(word() for _ in range(rnd.randint(0, 25))) + " " + (rnd.choice(items[:30])[1] if k % 3 == 0 else "x")) for k in range(120)]
    docs += [(200, None), (201, ""), (202, " ".join(["a"] * 60))]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")


def test_both_ways_find_the_same(spark):
    docs, items = _data(spark)
    a, b = (sorted(dc.contamination(docs, items, n).collect()) for n in (200_000, 0))
    assert a == b and len(a) == 123 and sum(r["contaminated"] for r in a) >= 40


def test_documents_are_not_winnowed_where_windows_are_few(spark):
    docs, items = _data(spark)
    windows = dc.benchmark_windows(items).localCheckpoint()
    plan = dc.find_hits(docs, windows)._jdf.queryExecution().optimizedPlan().toString()
    assert "least(" not in plan
    assert "least(" in dc.find_hits(docs, windows, 0)._jdf.queryExecution().optimizedPlan().toString()
