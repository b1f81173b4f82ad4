import random

from sievelog.llm import quality as Q


def test_every_code_point_has_codes_of_its_own():
    points = [*range(33, 0x300), *range(0xC00, 0xD800, 7), *range(0xE000, 0x110000, 501), 0x3FFFF, 0x40000, 0x10FFFF]
    points = [p for p in points if chr(p).split()]
    found = {tuple(Q.codes(chr(p)).tolist()) for p in points}
    assert len(found) == len(set(points)) and all(0 < c < 1 << Q.BITS for t in found for c in t)
    # 1,023 apart, which shared a code
    assert Q.codes("\u4e00").tolist() != Q.codes(chr(0x4E00 + 1023)).tolist()
    assert Q.codes("a\u4e00 b").tolist()[0] == ord("a") and len(Q.codes("a\u4e00 b")) == 5


def test_one_trusted_outlier_does_not_set_the_threshold(spark):
    rows = [("en", 4 + i / 1000, 1) for i in range(300)] + [("en", 90.0, 1)] + [("en", 6 + i / 10, 0) for i in range(100)]
    rows += [("fr", 4 + i / 1000, 1) for i in range(300)]
    found = {r.model: r.threshold for r in Q.thresholds(spark.createDataFrame(rows, "model string, perplexity double, quality int")).collect()}
    assert 4.2 < found["en"] < 6 and 4.2 < found["fr"] < 4.3


def test_wide_characters_on_both_paths(spark):
    rng = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(0, 3000, 40)] + ["\U00020000", "\U00050001"]
    rows = [(i, "".join(rng.choices(letters, k=60)), "zh") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(40)], "doc_id long, quality int")
    both = [{r.doc_id: r for r in Q.classify(docs, labels, broadcast_rows=n).select("row.doc_id", "perplexity", "n_units").collect()} for n in (10**6, 0)]
    for i in range(40):
        a, b = both[0][i], both[1][i]
        assert a.n_units == b.n_units >= 120 and abs(a.perplexity - b.perplexity) < 1e-3 * a.perplexity
