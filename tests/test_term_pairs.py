"""Vocabulary from words first and pairs of frequent words after, against a plain count."""

import math
import random
from collections import Counter

import pytest

from sievelog.operators import tfidf


def _plain(texts, limit, min_df, max_df):
    count, df = Counter(), Counter()
    for text in texts:
        words = (text or "").split()
        terms = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
        count.update(terms)
        df.update(set(terms))
    kept = [t for t in count if min_df <= df[t] <= max_df * len(texts)]
    kept = sorted(kept, key=lambda t: (-count[t], t))[:limit]
    return [(t, count[t], df[t]) for t in kept]


def _texts(seed):
    rnd = random.Random(seed)
    names = [f"w{k:02d}" for k in range(60)]
    rows = [" ".join(rnd.choices(names, [1 / (k + 1) for k in range(60)], k=rnd.randint(0, 40))) for _ in range(120)]
    return [*rows, None, "", "solo", "aa aa aa aa aa aa aa", "zz " * 900]


@pytest.mark.parametrize("limit, held", [(5, 50), (30, 400_000), (30, 7), (10_000, 400_000)])
def test_vocabulary_equals_a_plain_count(spark, monkeypatch, limit, held):
    monkeypatch.setattr(tfidf, "HELD", held)
    texts = _texts(limit)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, message string").repartition(3)
    model = tfidf.fit_tfidf(df, max_features=limit, max_df=0.7, stop_words=[])
    assert [(r["term"], r["count"], r["df"]) for r in model.vocabulary.collect()] == _plain(texts, limit, 2, 0.7)


def test_pairs_of_rare_words_are_not_counted(spark):
    df = spark.createDataFrame([(t,) for t in _texts(1)], "message string")
    words = tfidf._totals(df.select(tfidf._lines("message", [])), tfidf._words)
    among = tfidf._frequent(words, words["df"] >= 2, 10)
    assert len(among) < 20 and "w00" in among and "solo" not in among
    assert tfidf._pairs(["w00", "solo", "w00", "w01"], among) == ["w00 w01"]
    assert tfidf._frequent(words, words["df"] >= 2, 10_000) is None


def test_messages_that_share_a_key_are_normalised_together(spark):
    rows = [(1, "red blue"), (1, "red"), (2, "blue"), (3, None), (None, "red blue green")]
    df = spark.createDataFrame(rows, "k int, message string")
    model = tfidf.fit_tfidf(df, min_df=1, max_df=1.0, stop_words=[])
    found = tfidf.tfidf_weights(df, model, "k").collect()
    for key, n in ((1, 4), (2, 1), (None, 5)):
        own = [r["tfidf"] for r in found if r["k"] == key]
        assert len(own) == n and math.isclose(sum(x * x for x in own), 1)
    assert not [r for r in found if r["k"] == 3]
