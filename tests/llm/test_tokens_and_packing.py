import collections
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sievelog.llm import packing as P, tokens as K
from sievelog.llm.encoder import Encoder
from sievelog.session import scratch_path

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def fast():
    return Encoder(PATH)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aBzé É'\n\t<|>0ß&%ñİΣ́中ﬁµª²\x85\xa0s"), st.characters(codec="utf-8")), max_size=30))
def test_encoder_equals_the_library(library, fast, text):
    assert np.frombuffer(fast(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    text = "Two  spaces\nand it's <b>"
    assert np.frombuffer(Encoder(path)(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_codes_round_trip(ids):
    ids = np.array(ids, np.uint32)
    codes = K.Codes(*K.pack(ids))
    assert len(codes) == len(ids) and (codes.all() == ids).all()
    at = np.random.default_rng(1).permutation(len(ids))
    assert (codes.get(at) == ids[at]).all()


def encoded(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_files_round_trip_in_order(spark, documents, clashing, nothing, library, monkeypatch):
    monkeypatch.setattr(K, "SEGMENT", 500)
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = [encoded(library, t, 2) for _, t in rows]
    ends = np.cumsum([len(x) for x in ids])
    expected = sorted(
        ((i, int(e - len(x)), len(x), zlib.crc32(x.tobytes())) for (i, _), x, e in zip(rows, ids, ends)), key=lambda r: r[1]
    )
    for df in (documents, clashing):
        path = scratch_path(spark, "tokens")
        K.write(df, path, PATH, parts=3)
        assert sorted((tuple(r) for r in K.read(spark, path).collect()), key=lambda r: r[1]) == expected
    wanted = spark.createDataFrame([(4, 0), (4, 3), (15, 1), (4, 10**6), (77, 0)], "doc_id long, position long")
    got = {(r.doc_id, r.position): r.token for r in K.read_ids(spark, path, wanted).collect()}
    of = {i: x for (i, _), x in zip(rows, ids)}
    assert got == {(i, p): int(of[i][p]) for i, p in ((4, 0), (4, 3), (15, 1))}
    path = scratch_path(spark, "tokens")
    K.write(nothing, path, PATH)
    assert K.read(spark, path).count() == 0


@pytest.mark.parametrize("length", [4096, 64])
def test_packing_is_whole_and_gapless(documents, clashing, nothing, library, length):
    packed = [r.asDict() for r in P.pack(documents, PATH, length).collect()]
    cut = collections.Counter()
    for r in documents.collect():
        ids = encoded(library, r.text, 1)
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            cut[r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert cut == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
    sequences = collections.defaultdict(list)
    for r in packed:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    assert P.pack(clashing, PATH, length).count() == len(packed)
    assert P.pack(nothing, PATH, length).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 500), max_size=30))
def test_plans_hold_every_piece_once(histogram):
    slots = P.plan_packing(histogram, 100, 20)
    took = collections.Counter()
    used = collections.Counter()
    for size, first, sequences, base, offset, copies in slots.tolist():
        assert first == took[size]
        took[size] += sequences * copies
        assert offset + size * copies <= 100
        for s in range(base, base + sequences):
            used[s] += size * copies
    assert took == collections.Counter(histogram)
    assert all(v <= 100 for v in used.values())


def test_packing_comes_close_to_the_bound():
    sizes = np.clip(np.random.default_rng(1).lognormal(6.6, 1.0, 50_000).astype(int), 1, 4096)
    histogram = collections.Counter(sizes.tolist())
    slots = P.plan_packing(histogram)
    assert (slots[:, 3] + slots[:, 2]).max() <= 1.002 * sizes.sum() / 4096 + 1


def test_least_squares_use_up_an_exact_mixture():
    pats = P.patterns(8, np.arange(1, 9))
    truth = np.zeros(len(pats))
    truth[[0, 2, 5]] = 30, 20, 10
    goal = np.bincount(pats.ravel(), ((pats > 0) * truth[:, None]).ravel(), 9)
    x = P.fit_counts(pats, goal, 4000)
    assert (x >= 0).all()
    assert np.abs(np.bincount(pats.ravel(), ((pats > 0) * x[:, None]).ravel(), 9) - goal)[1:].max() < 0.5
