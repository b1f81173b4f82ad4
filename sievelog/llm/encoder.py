"""Token ids of whole texts, as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import functools
import json
import re
import struct
from collections.abc import Callable, Iterator

WORDS = 200_000
LONG_CHUNK = 64

# all but blanks and characters whose lower case and composition are one to one; contractions and special strings
_ODD = re.compile(r"[^ -~À-ÖØ-öø-ÿ]|'|<\|")
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^ a-zß-öø-ÿ0-9]+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Encoder:
    """Ids of a text without special tokens added; equal to the tokenizer's own on every text.

    A tokenizer that drops white space treats the stretches between spaces apart. Stretches of simple characters are cut
    into the pieces it would make, and each distinct piece is encoded once and remembered, up to ``WORDS`` of them; so is
    each distinct other stretch. Other tokenizers encode the whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            config = json.load(f)
        split = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pattern = split.get("pattern", {}).get("Regex", "")
        normalizers = [n["type"] for n in (config.get("normalizer") or {}).get("normalizers", [])]
        self.by_words = (
            normalizers == ["NFC", "Replace", "Lowercase"]
            and split.get("invert") is True
            and split.get("behavior") == "Removed"
            and pattern.endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        )
        self._letters = _byte_letters()
        self._model = self._tokenizer.model
        self._chunks = _Memory(self._whole)
        self._words = _Memory(self._word)

    def _word(self, word: str) -> bytes:
        letters = word if word.isascii() else "".join(map(self._letters.__getitem__, word.encode()))
        return _bytes([t.id for t in self._model.tokenize(letters)])

    def _simple(self, text: str) -> bytes:
        return b"".join(map(self._words.__getitem__, _PIECES.findall(text.lower())))

    def _whole(self, text: str) -> bytes:
        return _bytes(self._tokenizer.encode(text, add_special_tokens=False).ids) if text else b""

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_words:
            return self._whole(text)
        text = text.replace("\n", " ")
        odd = _ODD.search(text)
        if odd is None:
            return self._simple(text)
        out, done = [], 0
        while odd is not None:
            # the whole stretch between blanks around it
            start = max(done, text.rfind(" ", done, odd.start()) + 1)
            end = text.find(" ", odd.start())
            end = len(text) if end < 0 else end
            out += [self._simple(text[done:start]), self._chunks[text[start:end]]]
            odd, done = _ODD.search(text, end), end
        return b"".join([*out, self._simple(text[done:])])


def _bytes(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


_UNKNOWN = object()


class _Memory(dict):
    """Values by key, computed when missing, at most ``WORDS`` of them: when half are new, those before them are forgotten.

    None is a value like others. What is asked for again in the meantime is kept, so frequent words stay.
    """

    def __init__(self, compute):
        super().__init__()
        self._compute = compute
        self._before: dict = {}

    def __missing__(self, key: str) -> bytes:
        value = self._before.pop(key, _UNKNOWN)
        if value is _UNKNOWN:
            value = self._compute(key)
        if len(key) <= LONG_CHUNK:
            if len(self) >= WORDS // 2:
                self._before = dict(self)
                self.clear()
            self[key] = value
        return value


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function over batches, which afterwards gives the memory it no longer needs back to the system.

    A worker process lives on for the next stage, whose tasks would otherwise pay for what this one had at its largest.
    """

    def wrapped(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim is not None:
            trim(0)

    return wrapped


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file, kept between tasks."""
    return Encoder(path)
