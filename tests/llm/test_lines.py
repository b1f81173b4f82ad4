import collections
import hashlib

import numpy as np
import pytest

from sievelog.llm import lines as L
from sievelog.session import scratch_path


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(indexed, judged):
    held, top = collections.Counter(), {}
    for i, text in indexed:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= 20:
                held[k] += 1
                top[k] = max(top.get(k, -1), -1 if i is None else i)
    out = []
    for i, text in judged:
        every = (text or "").split("\n")
        kept = [x for x in every if not (held[key(x)] >= 3 and len(key(x)) >= 20 and top[key(x)] != (-1 if i is None else i))]
        out.append((i, "\n".join(kept), len(every), len(every) - len(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("row.doc_id", "kept", "n_lines", "n_dropped").collect()), key=str)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_equals_brute_force(documents, clashing, nothing):
    expected = brute(pairs(documents), pairs(documents))
    assert found(L.dedup_lines(documents)) == expected
    assert found(L.dedup_lines(clashing)) == expected
    assert L.dedup_lines(nothing).count() == 0
    assert any(r[3] for r in expected)


@pytest.mark.parametrize("bound", [L.FILTER_BYTES, 0])
def test_documents_can_be_added_and_removed(spark, monkeypatch, bound):
    monkeypatch.setattr(L, "FILTER_BYTES", bound)
    rows = [(i, "\n".join(f"common line number {k:04d}" for k in range(i % 7, 40, 1 + i % 5))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = L.LineIndex(spark, scratch_path(spark, "lines"))
    index.insert(docs.where("doc_id < 18"))
    index.insert(docs.where("doc_id >= 18"))
    assert found(L.clean(docs, index)) == brute(rows, rows)
    index.delete(docs.where("doc_id % 4 <> 1 or doc_id > 24").select("doc_id"))
    left = [r for r in rows if r[0] % 4 == 1 and r[0] <= 24]
    assert found(L.clean(docs.where("doc_id % 4 = 1 and doc_id <= 24"), index)) == brute(left, left)
    index.insert(docs.where("doc_id % 4 <> 1 or doc_id > 24"))
    assert found(L.clean(docs, index)) == brute(rows, rows)


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    digests = L._words([hashlib.md5(str(i).encode()).digest() for i in range(4000)])
    cuckoo = L.CuckooFilter.sized(2000)
    cuckoo.insert(digests[:2000])
    assert cuckoo.contains(digests[:2000]).all() and cuckoo.contains(digests[2000:]).mean() < 0.01
    cuckoo.delete(digests[:1000])
    assert cuckoo.contains(digests[1000:2000]).all() and cuckoo.contains(digests[:1000]).mean() < 0.01
    tiny = L.CuckooFilter(4)
    tiny.insert(digests)
    assert tiny.full and np.all(tiny.contains(digests))
