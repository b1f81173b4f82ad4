"""Trained operators: held-out accuracy, exactness of their parts, awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelog.llm import langid as G, quality as Q, toxicity as X

ROOTS = {"aa": ["ka", "lo", "mi"], "bb": ["ße", "ün", "öt"], "cc": ["que", "eau", "çoi"]}


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(ROOTS))
        words = ["".join(rng.choices(ROOTS[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_gradients_equal_differences():
    net = G.Network.fresh(["x", "y"], hidden=3)
    net.table, net.recurrent, net.out = (w.astype(np.float64) for w in (net.table, net.recurrent, net.out))
    data = np.random.default_rng(0).integers(0, 256, (2, 5)).astype(np.uint8)
    pull = np.random.default_rng(1).normal(size=(5, 2, 3)).astype(np.float32)
    for direction in (0, 1):
        d_table, d_u = G._backward(net, data, net.states(data, direction), pull, direction)
        for w, d, at in ((net.recurrent[direction], d_u, (1, 4)), (net.table[direction], d_table, (data[0, 2], 7))):
            kept, step = w[at], 1e-2
            w[at] = kept + step
            up = (net.states(data, direction) * pull).sum()
            w[at] = kept - step
            down = (net.states(data, direction) * pull).sum()
            w[at] = kept
            assert abs((up - down) / (2 * step) - d[at]) < 2e-2


def test_language_of_held_out_documents(spark, documents, clashing, nothing):
    df = spark.createDataFrame(corpus(240), "doc_id long, text string, lang string")
    found = G.identify(df).select("row.doc_id", "row.lang", "held_out", "lang_pred", "score").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)
    net = G.train(df, G.remainder(3) == 1)
    odd = G.predict(clashing, net).select("row.text", "lang_pred", "score").collect()
    assert len(odd) == documents.count()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd)
    assert G.identify(nothing).count() == 0
    assert {r.lang_pred for r in G.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_all_bytes_are_labelled_and_pooled():
    net = G.Network.fresh(["x", "y"], seed=4)
    texts = [b"a" * 300, b"b", b"c" * G.STEPS]
    pooled = G.pooled(net, texts)
    for text, row in zip(texts, pooled):
        parts = [text[i : i + G.STEPS] for i in range(0, len(text), G.STEPS)]
        total = np.zeros(2)
        for part in parts:
            padded = np.frombuffer(part + bytes(G.STEPS - len(part)), np.uint8)[None]
            total += net.positions(padded)[: len(part), 0].sum(0)
        assert np.allclose(total / len(text), row, atol=1e-5)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_automaton_meets_all_terms_within_reach():
    rng = random.Random(2)
    terms = ["".join(rng.choices("abc", k=rng.randint(3, 7))) for _ in range(25)]
    trie = X.Trie([(t, 1.0, False) for t in terms])
    for _ in range(400):
        word = "".join(rng.choices("abc", k=rng.randint(2, 8)))
        for k in (0, 1, 2):
            least = min(edits(word, t) for t in terms)
            near = trie.near(word, k)
            assert (near[2] if near else None) == (least if least <= k else None)


def test_toxic_terms_misspellings_and_quotation(spark, documents, clashing, nothing):
    rng = random.Random(9)
    plain = [f"word{i}x" for i in range(80)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=40)
        toxic, quoting = i % 4 == 0, i % 12 == 1
        if toxic:
            words[5:5] = ["you", rng.choice(["grumble", "snarkle"])]
        if quoting:
            words[5:5] = ["they", "wrote", '"' + rng.choice(["grumble", "snarkle"]) + '"']
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, " ".join(plain[:30]) + " you grumbl " + " ".join(plain[30:60])), (1001, "you snarkIe, you grumbl and snarklle"), (1002, None)]
    docs, labels = (spark.createDataFrame(r, s) for r, s in ((rows, "doc_id long, text string"), (labels, "doc_id long, toxic int")))
    model = X.train(docs, labels)
    found = {r.doc_id: r for r in X.score(docs, model).select("row.doc_id", "score", "n_hits").collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [(found[i].score >= X.THRESHOLD) == (i % 4 == 0) for i in held]
    assert np.mean(right) > 0.95
    quoted = [found[i].score < X.THRESHOLD for i in range(600) if i % 12 == 1]
    assert np.mean(quoted) > 0.9
    assert found[1000].n_hits >= 1 and found[1001].n_hits >= 3 and found[1001].score > found[1002].score
    assert 0 <= found[1002].score < X.THRESHOLD
    assert X.score(clashing, model).count() == documents.count()
    assert X.toxicity(nothing, labels).count() == 0
    assert {r.score for r in X.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}


@pytest.fixture(scope="module")
def judged(spark):
    rows = corpus(160)
    rows += [(500 + i, "%$# zz9 @@ xq " * 12, "aa") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(i, 1) for i in range(160)], "doc_id long, quality int")


def test_model_is_a_distribution(spark, judged):
    docs, _ = judged
    seen, backed = Q.build(docs.select("text", "lang").where("doc_id < 160"))
    local = Q.Local([t.toArrow() for t in seen], [t.toArrow() for t in backed])
    for lang in local.langs:
        for context in (Q.codes("kal"), Q.codes("eau "), Q.codes("zzzz")):
            stem = int(Q.runs(context)[-1])
            g = (stem << Q.BITS & ((1 << Q.BITS * Q.ORDER) - 1)) | np.arange(1 << Q.BITS)
            assert abs(np.exp(local.log_probability(g, lang).astype(np.float64)).sum() - 1) < 1e-3


def test_junk_is_found_and_both_paths_agree(spark, judged, clashing, nothing):
    docs, labels = judged
    here = {r.doc_id: r for r in Q.classify(docs, labels).select("row.doc_id", "perplexity", "keep").collect()}
    assert not any(here[500 + i].keep for i in range(10))
    assert np.mean([here[i].keep for i in range(160)]) > 0.97
    joined = {r.doc_id: r for r in Q.classify(docs, labels, broadcast_rows=0).select("row.doc_id", "perplexity", "keep").collect()}
    assert all(abs(here[i].perplexity - joined[i].perplexity) < 1e-3 * here[i].perplexity for i in here)
    odd = Q.classify(clashing, labels).select("row.text", "perplexity", "keep").collect()
    assert all(r.keep for r in odd if not (r.text or "").strip())
    assert Q.classify(nothing, labels).count() == 0
    assert all(r.keep for r in Q.classify(docs, labels.where("false")).collect())


def test_every_language_is_learned(spark):
    from pyspark.sql import functions as F

    from sievelog.llm import langid

    rows = [(i, f"text {i} of l{i % 70}", f"l{i % 70:02}") for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.train(docs, F.lit(False), sample=2).labels) == 70


def test_labels_other_than_0_and_1_say_nothing(spark):
    from sievelog.llm import toxicity

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, [0, 1, 2, -1, None][i % 5]) for i in range(40)], "doc_id long, toxic int")
    assert {r.y for r in toxicity.labelled(docs, labels).collect()} == {0, 1}
    assert toxicity.toxicity(docs, labels).count() == 40
