import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sievelog.llm import periods
from sievelog.llm.queries import op12_periodic_runs
from tests.oracle import ROOT


def brute_runs(words, least=6, power=4):
    """Maximal stretches of every period whose smallest period it is."""
    out, n = [], len(words)
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            start, length = i, e - i + q
            part = words[start : start + length]
            if length >= max(least, power * q) and all(part[p:] != part[:-p] for p in range(1, q)):
                out.append((start, length, q))
            i = e
    return sorted(out)


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *four, sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(1, 9)), min_size=1, max_size=6)


def spelled(parts):
    return [x for part, times in parts for x in part * times]


@settings(deadline=None, max_examples=400)
@given(pieces)
def test_catchers_find_all_runs(parts):
    words = spelled(parts)
    catchers = periods.Catchers()
    catchers.append(np.array(words, np.int64))
    assert catchers.runs() == brute_runs(words)


@settings(deadline=None, max_examples=100)
@given(pieces, st.lists(st.integers(1, 9), min_size=1, max_size=8))
def test_words_may_come_in_any_portions(parts, portions):
    words = spelled(parts)
    catchers, at, k = periods.Catchers(), 0, 0
    while at < len(words):
        size = portions[k % len(portions)]
        catchers.append(np.array(words[at : at + size], np.int64))
        at, k = at + size, k + 1
        assert catchers.runs() == brute_runs(words[:at])


@settings(deadline=None, max_examples=100)
@given(st.lists(pieces, max_size=6))
def test_texts_do_not_meet(many):
    texts = [[b"%d" % x for x in spelled(parts)] for parts in many]
    assert periods.find_runs(texts) == [brute_runs(words) for words in texts]


def test_binary_words_and_higher_powers():
    rng = np.random.default_rng(1)
    for _ in range(300):
        words = rng.integers(0, 2, rng.integers(0, 120)).tolist()
        texts = [[b"%d" % x for x in words]]
        assert periods.find_runs(texts) == [brute_runs(words)]
        assert periods.find_runs(texts, 8, 5) == [brute_runs(words, 8, 5)]
    with pytest.raises(ValueError):
        periods.find_runs([], power=3)


def test_one_word_a_million_times_and_a_long_period():
    words = [b"x"] * 1_000_000
    assert periods.find_runs([words]) == [[(0, 1_000_000, 1)]]
    part = [b"%d" % i for i in range(50_000)]
    assert periods.find_runs([[b"y", *part * 4, *part[:7], b"z"]]) == [[(1, 200_007, 50_000)]]


def test_awkward_documents(spark, documents, clashing, nothing):
    runs = "go round and round " * 9
    more = [(200 + i, t, "en", "s", None) for i, t in enumerate([runs, "a " * 5, "a " * 6, "a a " * 4, "a b\n" * 4, "x " + "p q r " * 4])]
    docs = documents.unionByName(spark.createDataFrame(more, documents.schema))
    for r in periods.periodic_runs(docs).select("row.text", "n_words", "runs", "collapsed").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        expected = brute_runs(words)
        gone = {i for s, length, q in expected for i in range(s + q, s + length)}
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == expected
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periods.periodic_runs(clashing).select("row.*").columns == clashing.columns
    assert periods.periodic_runs(nothing).count() == 0


def test_query_equals_brute_force(spark, documents, tmp_path):
    many = [(300 + i, " ".join(f"w{(i * k) % 9}" for k in range(i % 60)), "en", "s", None) for i in range(400)]
    documents.unionByName(spark.createDataFrame(many, documents.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").collect()
    found = [tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted((brute_row(r.doc_id, r.text) for r in docs), key=repr)
    assert sum(r[1] > 0 for r in found) > 20


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/sf0.001"), reason="test tables not present")
def test_whole_table(spark):
    sf = f"{ROOT}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = [r for r in docs if len(r.text or "") < 6000]
    found = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, sf).collect()}
    assert len(found) == len(docs)
    assert all(found[r.doc_id] == brute_row(r.doc_id, r.text) for r in short)
