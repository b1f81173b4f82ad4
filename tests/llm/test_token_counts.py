import pytest
from hypothesis import given, settings, strategies as st

from sievelog.llm import token_counts
from sievelog.llm.queries import op13_token_counts, tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES = "byte_bpe_50k.json"
SPECIAL = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>\n\ny", "  two  spaces ", "it's  we'll\nI'd 'S", "tab\tnew\r\nline nbsp", " em 　x", "", "\n", " a\n b"]


def library(name):
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer(name))
        return lambda t: len(model.encode(t))
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer(name))
    return lambda t: len(found.encode(t, add_special_tokens=False).ids)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", [BYTES, "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, documents, tmp_path, name):
    docs = documents.unionByName(spark.createDataFrame([(500 + i, t, "en", "s", None) for i, t in enumerate(SPECIAL)], documents.schema))
    cache = token_counts.TokenCache(spark, str(tmp_path), tokenizer(name))
    count = library(name)
    found = token_counts.count_tokens(docs, cache, limit=5)
    expected = []
    for r in docs.collect():
        n = count(r.text or "")
        expected.append((r.doc_id, len((r.text or "").encode()), n, n > 5))
    assert rows_of(found) == sorted(expected, key=repr)


@settings(deadline=None, max_examples=400)
@given(st.lists(st.sampled_from(["a", "Word", "é", "'s", "'", " ", " ", "\n", "\t", "12", "<|endoftext|>", "<|", "中", " ", "​", "̀", "🙂", "."]), max_size=14))
def test_cuts_change_no_count(parts):
    text = "".join(parts)
    assert token_counts.counter(tokenizer(BYTES))([text]) == [library_count(text)]


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_any_texts(texts):
    assert token_counts.counter(tokenizer(BYTES))(texts) == [library_count(t) for t in texts]


def test_every_character_between_words():
    """All characters up to the end of the letters and symbols in use, each in four surroundings."""
    count = token_counts.counter(tokenizer(BYTES))
    texts = [f for c in range(0x3100) if not 0xD800 <= c < 0xE000 for f in (f"ab{chr(c)}cd", f"ab {chr(c)} cd", f"ab\n{chr(c)}.cd", f"ab,{chr(c)}")]
    assert count(texts) == [library_count(t) for t in texts]


def library_count(text, _held=[]):
    if not _held:
        _held.append(library(BYTES))
    return _held[0](text)


def test_a_second_run_encodes_only_new_texts(spark, documents, tmp_path, monkeypatch):
    path = tokenizer(BYTES)
    cache = token_counts.TokenCache(spark, str(tmp_path), path)
    distinct = len({r.text or "" for r in documents.collect()})
    first = rows_of(token_counts.count_tokens(documents, cache))
    assert cache.stored().count() == distinct
    appended = []
    append = token_counts.TokenCache.append
    monkeypatch.setattr(token_counts.TokenCache, "append", lambda self, c: (appended.append(c.count()), append(self, c))[1])
    again = token_counts.TokenCache(spark, str(tmp_path), path)
    assert rows_of(token_counts.count_tokens(documents, again)) == first and appended == []
    new = spark.createDataFrame([(900, "never seen before", "en", "s", 17), (901, "never seen before", "en", "s", 17)], documents.schema)
    more = rows_of(token_counts.count_tokens(documents.unionByName(new), again))
    assert appended == [1] and len(more) == len(first) + 2 and cache.stored().count() == distinct + 1
    # the way of many misses gives the same
    monkeypatch.setattr(token_counts, "SMALL", 0)
    other = token_counts.TokenCache(spark, str(tmp_path / "other"), path)
    assert rows_of(token_counts.count_tokens(documents.unionByName(new), other)) == more


def test_another_tokenizer_meets_no_old_counts(spark, documents, tmp_path):
    a = token_counts.TokenCache(spark, str(tmp_path), tokenizer(BYTES))
    token_counts.count_tokens(documents, a)
    b = token_counts.TokenCache(spark, str(tmp_path), tokenizer("word_bpe_49k.json"))
    assert b.stored().count() == 0 and a.path != b.path


def test_equal_digests_stored_twice_are_read_once(spark, documents, tmp_path):
    cache = token_counts.TokenCache(spark, str(tmp_path), tokenizer(BYTES))
    first = rows_of(token_counts.count_tokens(documents, cache))
    cache._store(cache.stored())
    assert rows_of(token_counts.count_tokens(documents, cache)) == first


def test_kept_columns_and_empty_tables(spark, clashing, nothing, tmp_path):
    cache = token_counts.TokenCache(spark, str(tmp_path), tokenizer(BYTES))
    assert token_counts.count_tokens(nothing, cache).count() == 0 and cache.stored().count() == 0
    found = token_counts.count_tokens(clashing, cache, ("doc_id", "token", "row", "n", "key"))
    assert found.count() == clashing.count() and found.where("row <> 'clash' or n <> 'clash'").count() == 0


def test_query(spark, documents, tmp_path):
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    found = op13_token_counts(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    expected = [(r.doc_id, len((r.text or "").encode()), (n := library_count(r.text or "")), n > 1024) for r in documents.collect()]
    assert rows_of(found) == sorted(expected, key=repr)
