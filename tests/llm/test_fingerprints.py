import hashlib
import re

from pyspark.sql import functions as F

from sievelog.llm import fingerprints as X


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_edited_texts_and_likeness(spark):
    rows = [(i, f"{'w%d ' % i * (i % 3)}alpha beta gamma delta epsilon zeta eta {i % 4}") for i in range(40)]
    docs = spark.createDataFrame([*rows, (40, None), (41, "")], "doc_id long, text string")
    found = {r.doc_id: r for r in X.edited_fingerprints(docs, cells=7).collect()}
    order = sorted(found, reverse=True)
    texts = dict([*rows, (40, ""), (41, "")])
    for at, i in enumerate(order):
        after = texts[order[(at + 1) % len(order)]]
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + after[:half]
        r = found[i]
        assert r.n_chars == len(texts[i])
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(shingles(texts[i]), shingles(edited))) < 1e-9
        assert abs(r.near_next - jaccard(shingles(texts[i]), shingles(after))) < 1e-9


def test_awkward_rows(documents, clashing, nothing):
    found = X.edited_fingerprints(documents).collect()
    assert len(found) == documents.count()
    assert X.edited_fingerprints(clashing).count() == len(found)
    assert X.edited_fingerprints(nothing).count() == 0
    by_id = {r.doc_id: r.fingerprint for r in found if r.doc_id is not None}
    assert by_id[0] == by_id[1] == by_id[2] == ""
    assert by_id[4] == by_id[6] == by_id[7] != by_id[5]


def test_one_document_follows_itself(spark):
    one = X.edited_fingerprints(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).head()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    texts = [(k, " ".join(f"t{i}" for i in range(a, b))) for k, a, b in ((0, 0, 3000), (0, 2000, 5000), (1, 0, 4000))]
    df = spark.createDataFrame(texts, "k int, text string").withColumn("fp", X.fingerprint(F.col("text")))
    merged = {r.k: r.fp for r in X.merge_groups(df, ["k"], "fp").collect()}
    whole = spark.createDataFrame([(" ".join(f"t{i}" for i in range(3000)),)], "a string")
    assert len(merged[0]) == X.K
    row = df.where("k = 1").select(X.distinct_shingles(F.col("fp")).alias("n")).head()
    assert abs(row.n - 3996) < 3996 * 4 / X.K**0.5
    a = whole.select(X.fingerprint(F.col("a")).alias("a"))
    both = a.crossJoin(df.where("k = 1").select("fp")).select(
        X.containment(F.col("a"), F.col("fp")).alias("c"), X.resemblance(F.col("a"), F.col("fp")).alias("r")
    ).head()
    assert abs(both.r - 2996 / 3996) < 0.1 and both.c > 0.9
