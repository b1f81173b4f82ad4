"""The encoder's memory of words: bounded, and frequent ones outlive many rare ones."""

from collections import Counter

from sievelog.llm import encoder


def test_frequent_words_are_computed_once(monkeypatch):
    monkeypatch.setattr(encoder, "WORDS", 100)
    calls = Counter()

    def compute(key):
        calls[key] += 1
        return key.encode()

    memory = encoder._Memory(compute)
    for k in range(2000):
        for key in ("often", "", f"rare{k}"):
            assert memory[key] == key.encode()
        assert len(memory) + len(memory._before) <= 100
    assert calls["often"] == 1 and calls[""] == 1 and max(calls.values()) == 1
    long = "x" * (encoder.LONG_CHUNK + 1)
    assert memory[long] == memory[long] and calls[long] == 2


def test_none_is_remembered_too(monkeypatch):
    monkeypatch.setattr(encoder, "WORDS", 100)
    calls = Counter()

    def compute(key):
        calls[key] += 1

    memory = encoder._Memory(compute)
    for k in range(2000):
        assert memory["often"] is None and memory[f"rare{k}"] is None
    assert max(calls.values()) == 1
