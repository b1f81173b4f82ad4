"""Words, shingles and other text columns that several operators share; JVM expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = "\t\n\x0b\x0c\r "
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row; a repeated column would be computed at each mention."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII takes the fast path, which changes the same letters."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def space_words(text: Column) -> Column:
    """Lower-cased runs of anything but ASCII white space."""
    return F.array_remove(F.split(lower_ascii(whole(text)), SPACE_RUN), "")


def letter_words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return F.array_remove(F.split(lower_ascii(whole(text)), WORD_GAP), "")


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, width: int) -> Column:
    """One hash for each run of ``width`` words; fewer words count as one shingle, no words have none."""

    def runs(h: Column) -> Column:
        inside = F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (width - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[h[i + k] for k in range(1, width)]),
        )
        return (
            F.when(F.size(h) >= width, inside)
            .when(F.size(h) > 0, F.array(F.xxhash64(h)))
            .otherwise(F.slice(h, 1, 0))
        )

    return bind(word_hashes(words), runs)
