"""The encoder remembers the pieces of simple words, not each spelling with its punctuation, and equals the library."""

import random

import numpy as np

from sievelog.llm.encoder import Encoder
from sievelog.llm.queries import tokenizer


def test_punctuation_and_case_do_not_make_new_words():
    encode = Encoder(tokenizer())
    marks = [a + b for a in "?!.,;" for b in "?!.,;"]
    encode(" ".join(w + m for w in ("word", "Word", "WORD") for m in marks))
    assert set(encode._words) == {"word", *marks} and not encode._chunks


def test_mixed_texts_equal_the_library():
    from tokenizers import Tokenizer

    library, encode, rng = Tokenizer.from_file(tokenizer()), Encoder(tokenizer()), random.Random(1)
    parts = ["Word", "it's", "É", "é", "×", "中文", "İ", "ﬁn", "<|endoftext|>", "<|", "12a", "...", "ÿß", " ", "  ", "\n", "\t", " ", " ", "'", "🙂", "́", "\x00"]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
