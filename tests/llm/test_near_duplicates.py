import corpus_pipeline as C


def similarity(a, b, width):
    a, b = ({tuple(t.split()[i : i + width]) for i in range(len(t.split()) - width + 1)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_pair_between_80_and_85_percent_is_one_document(spark):
    words = [f"w{i}" for i in range(94)]
    # two words changed: ten of the 90 shingles of each side are unlike
    near = [*words[:40], "x", *words[41:80], "y", *words[81:]]
    far = [*near[:20], "z", *near[21:]]
    texts = [" ".join(t) for t in (words, near, far, [f"v{i}" for i in range(60)])]
    assert 0.80 <= similarity(texts[0], texts[1], 5) < 0.85 and similarity(texts[0], texts[1], 4) < 0.85
    assert similarity(texts[0], texts[2], 5) < 0.80
    docs = spark.createDataFrame([(i, texts[i]) for i in (0, 1, 3)], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(C.STAGES)["near_duplicates"](spark, docs, "").collect()) == [0, 3]
    docs = spark.createDataFrame([(i, texts[i]) for i in (0, 2, 3)], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(C.STAGES)["near_duplicates"](spark, docs, "").collect()) == [0, 2, 3]
