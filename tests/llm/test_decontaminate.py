import hashlib
import re

import pytest

from sievelog.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 9)) if w else []:
            windows.setdefault(tuple(w[s : s + 10]), set()).add(item)
    out = []
    for i, text in docs:
        w, hit, met = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    met |= windows[tuple(w[s : s + n])] - {None}
        ids = ",".join(sorted(map(str, met)))
        out.append((i, len(w), len(hit), len(met), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [
    (1, "The quick, brown fox jumps over one lazy dog while nine old owls!"),
    (2, "brown fox jumps over one lazy dog while nine old owls watch from"),
    (10, "two three"),
    (11, "owls"),
    (12, None),
    (13, "?!"),
    (None, "watch from the tall dark oak tree near our house and more"),
    (2, "same same same same same same same same same same same"),
]


@pytest.mark.parametrize("limit", [D.BROADCAST_WINDOWS, 0])
def test_equals_brute_force(spark, documents, limit):
    extra = spark.createDataFrame([(90, "same " * 40, "en", "s", 0), (91, "x fox jumps over one lazy dog while nine old", "en", "s", 0)], documents.schema)
    docs = documents.unionByName(extra)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = sorted((tuple(r) for r in D.contamination(docs, items, limit).collect()), key=str)
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)


def test_empty_tables_and_clashing_columns(spark, documents, clashing, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.where("false")
    assert D.contamination(nothing, items).count() == 0
    clean = D.contamination(documents, none).collect()
    assert len(clean) == documents.count() and not any(r.contaminated for r in clean)
    hits = sum(r.contaminated for r in D.contamination(clashing, items).collect())
    assert hits and D.without_hits(clashing, items).count() == clashing.count() - hits
    assert D.without_hits(clashing, items).columns == clashing.columns


def test_every_span_of_ten_words_shares_a_mark(spark):
    base = " ".join(f"v{i * 7919 % 1009}" for i in range(300))
    items = spark.createDataFrame([(1, base)], "item_id long, text string")
    w = base.split()
    docs = spark.createDataFrame([(s, f"left{s} " + " ".join(w[s : s + 10]) + f" right{s}") for s in range(0, 290, 7)], "doc_id long, text string")
    assert all(r.n_hit == 10 for r in D.contamination(docs, items).collect())
