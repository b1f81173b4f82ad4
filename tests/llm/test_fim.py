import hashlib
import os
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from sievelog.llm import fim
from sievelog.llm.queries import ORACLES, QUERIES
from tests.oracle import ROOT, compare, connect


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts(spark, documents):
    marked = [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(["a<P>b", "x<S>", "<M>", "<<S", "<P<S", "<", "a <P <S <M", "é" * 5000, "🙂x" * 9000])]
    many = [(2000 + i, f"t{i} " * (i % 7 + 1), "en", "s", None) for i in range(300)]
    return documents.unionByName(spark.createDataFrame(marked + many, documents.schema))


def test_equals_brute_force_and_rebuilds(texts):
    made = fim.fill_in_middle(texts).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    rows = made.select("row.doc_id", "row.text", "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    assert len(rows) == texts.count() and {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert tuple(r)[2:7] == brute(r.doc_id, r.text)
        assert r.back == (r.text or "")


def test_clashing_columns_and_empty_tables(clashing, nothing):
    made = fim.fill_in_middle(clashing)
    assert made.count() == clashing.count() and made.select("row.*").columns == clashing.columns
    assert fim.fill_in_middle(nothing).count() == 0


def test_units_of_a_pattern(documents):
    made = fim.fill_in_middle(documents, unit=r"\S+\s*")
    made = made.withColumn("back", fim.restored(F.col("output"), F.col("form")))
    for r in made.select("row.text", "n", "form", "prefix_chars", "middle_chars", "back").collect():
        text = r.text or ""
        assert r.back == text and r.n == len(re.findall(r"\S+\s*", text))
        if r.form != "plain":
            ends = {0, *(m.end() for m in re.finditer(r"\S+\s*", text))}
            assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= ends


def test_marks_that_could_be_imitated_are_refused(documents):
    with pytest.raises(ValueError):
        fim.fill_in_middle(documents, marks=("aa", "<S>", "<M>"))
    with pytest.raises(ValueError):
        fim.fill_in_middle(documents, marks=("<P>", "<P>", "<M>"))


@settings(deadline=None, max_examples=150)
@given(st.text(max_size=60), st.integers(1, 9))
def test_every_cut_of_small_blocks(text, block):
    cutter = fim.Cutter(text.encode(), block=block)
    assert cutter.n == len(text)
    for k in range(len(text) + 1):
        assert cutter.cut(k) == (len(text[:k].encode()), k)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=40), st.data())
def test_tree_after_changes(counts, data):
    import numpy as np

    tree = fim.BlockTree(*np.array(counts).T)
    at = data.draw(st.integers(0, len(counts) - 1))
    tree.add(at, 3, 7)
    counts[at] = (counts[at][0] + 3, counts[at][1] + 7)
    for b in range(len(counts) + 1):
        assert tree.before(b) == (sum(u for u, _ in counts[:b]), sum(p for _, p in counts[:b]))
    seen = 0
    for b, (u, _) in enumerate(counts):
        for inside in range(1, u + 1):
            assert tree.find(seen + inside) == (b, inside, sum(p for _, p in counts[:b]))
        seen += u


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="test tables not present")
def test_query_equals_sql(spark):
    sf = f"{ROOT}/sf0.001"
    assert compare(QUERIES["op11_fill_in_middle"](spark, sf), connect(sf), ORACLES["op11_fill_in_middle"]) is None
