import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievelog.functions.vectors import cosine
from sievelog.operators import semantic, tfidf

STOP = ["the", "a"]
DOCS = [
    "the quick brown fox",
    "The QUICK brown dog, the end",
    "quick quick brown",
    "quick x y z é1 é1",
    "quick",
    "",
    "lone wolf brown",
    "a the",
    "dog_1 end",
    "end",
]


def _terms(text):
    words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in STOP]
    return Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])


def _expected(docs, limit):
    counts = [_terms(d) for d in docs]
    total, df = Counter(), Counter()
    for c in counts:
        total.update(c)
        df.update(c.keys())
    kept = [t for t in total if df[t] >= 2 and df[t] <= 0.8 * len(docs)]
    kept = sorted(kept, key=lambda t: (-total[t], t))[:limit]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept}
    weights = {}
    for i, c in enumerate(counts):
        w = {t: n * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        weights.update({(i, t): x / norm for t, x in w.items()})
    return kept, weights


@pytest.mark.parametrize("limit", [2, 1000])
def test_weights(spark, limit):
    df = spark.createDataFrame(list(enumerate(DOCS)), "i int, message string")
    model = tfidf.fit_tfidf(df, max_features=limit, stop_words=STOP)
    kept, weights = _expected(DOCS, limit)
    assert {r["term"] for r in model.vocabulary.collect()} == set(kept)
    found = {(r["i"], r["term"]): r["tfidf"] for r in tfidf.tfidf_weights(df, model, "i").collect()}
    assert found.keys() == weights.keys()
    for k, v in weights.items():
        assert found[k] == pytest.approx(v)


def test_share_limit_is_inclusive(spark):
    df = spark.createDataFrame([(i, "often" + (" always" if i < 5 else "")) for i in range(6)], "i int, message string")
    df = df.withColumn("message", F.when(F.col("i") == 5, "always").otherwise(F.col("message")))
    found = {r["term"] for r in tfidf.fit_tfidf(df, max_df=5 / 6, stop_words=[]).vocabulary.collect()}
    assert "often" in found and "always" not in found


def test_default_stop_words(spark):
    df = spark.createDataFrame([(0, "the failed login"), (1, "the failed logout")], "i int, message string")
    model = tfidf.fit_tfidf(df, max_df=1.0)
    assert [r["term"] for r in model.vocabulary.collect()] == ["failed"]


def test_rare_words(spark):
    docs = ["a b c", "a b B", "a d", "a", ""]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, message string")
    found = {r["i"]: r["rare_words"] for r in tfidf.rare_words(df, "i", max_df=1).collect()}
    assert found == {0: 1, 1: 0, 2: 1, 3: 0, 4: 0}


def test_each_message_is_encoded_once(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 else f"m{i}") for i in range(300)], "i int, message string")
    assert semantic.message_memo(df).count() == 101
    out = semantic.encode_messages(df, ["i"], salts=4)
    assert out.count() == 300 and out.where("embedding is null").count() == 0
    assert out.where("message = 'same'").select("embedding").distinct().count() == 1


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [pytest.approx(0.5**0.5), None]
