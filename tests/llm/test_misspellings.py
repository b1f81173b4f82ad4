import random
import zlib

import numpy as np

from sievelog.llm import toxicity as X


def test_stems_long_terms_swaps_and_four_letters():
    counts = [("moro*", 60, 0), ("moron", 40, 0), ("morons", 30, 0), ("scum", 50, 0), ("disgusting", 30, 0)]
    terms = X.choose_terms(counts, 200, 800)
    assert {t for t, _, _ in terms} >= {"moro", "moron", "morons"}
    match = X.Model(terms).matcher()
    for word in ("m0ron", "mor0n", "morron", "m0ronically", "mroon", "scvm", "scmu", "disgsutnig", "d1sgust1ng"):
        assert match(word) and not match(word)[1], word
    assert match("moronic")[1] and not match("plain") and not match("cat")


def test_the_walk_loses_nothing_to_the_test_before_it():
    rng = random.Random(4)
    for _ in range(40):
        terms = {"".join(rng.choices("abc", k=rng.randint(3, 11))): (1.0, rng.random() < 0.4) for _ in range(10)}
        terms = [(t, w, s) for t, (w, s) in terms.items()]
        match = X.Model(terms).matcher()
        long = X.Trie([t for t in terms if len(t[0]) >= 9])
        short = X.Trie([t for t in terms if len(t[0]) >= 4])
        for _ in range(60):
            word = "".join(rng.choices("abc", k=rng.randint(3, 14)))
            near = X.Trie(terms).exact(word) or short.near(word, 1, swaps=True) or long.near(word, 2, swaps=True)
            assert bool(match(word)) == bool(near)


def test_misspelling_that_a_clean_document_holds_once_still_counts(spark):
    rng = random.Random(9)
    plain = [f"word{i}x" for i in range(80)]
    rows, labels = [], []
    for i in range(800):
        words = rng.choices(plain, k=40)
        toxic, quoting = i % 4 == 0, i % 4 == 1
        term = rng.choice(["grumble", "snarkle"])
        if toxic:
            words[5:5] = ["you", "vile", "snarkel" if i % 20 == 0 else term]
        if quoting:
            words[5:5] = ["they", "wrote", f'"{term}"']
        if i == 3:
            words[9:9] = ["snarkel"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, " ".join(plain[:30]) + " you vile grumbel " + " ".join(plain[30:60])), (1001, "you vile snarkel")]
    docs, labels = (spark.createDataFrame(r, s) for r, s in ((rows, "doc_id long, text string"), (labels, "doc_id long, toxic int")))
    model = X.train(docs, labels)
    found = {r.doc_id: r for r in X.score(docs, model).select("row.doc_id", "score", "n_hits").collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(found[i].score >= X.THRESHOLD) == (i % 4 == 0) for i in held]) > 0.95
    match = model.matcher()
    assert match("grumbel") and match("snarkel") and found[1000].n_hits >= 1 and found[1001].n_hits >= 1


def test_evidence_alone_bounds_the_lexicon():
    words = [f"{a}{b}{c}word" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    assert len(X.choose_terms([(w, 60, 0) for w in words], 9_000, 9_000)) == len(words) == 512
    assert X.SAMPLE == 12_000
