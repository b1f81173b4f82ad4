"""Column expressions over message text.

Whitespace and word characters are spelled out as explicit classes rather than ``\\s`` and ``\\w``: the
built-in classes are ASCII-only in ``java.util.regex``, and the explicit ones read the same in any dialect.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: Unicode white space, as a regex class body and as plain characters
WS = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# the same two classes through the engine's own white-space property, which tests faster than a list
SPACE = r"(?U:[\s\x1c-\x1f])"
NON_WS = r"(?U:[^\s\x1c-\x1f])"
WORD = r"[\p{L}\p{N}_]"

# fixed values: non-decimal digits (superscripts, subscripts, circled) and upper-case symbols outside Lu
DIGITS = (
    r"\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}"
    r"\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
)
UPPER = r"\p{Lu}\x{2160}-\x{216f}\x{24b6}-\x{24cf}"
LETTERS = r"\p{L}"
ALNUM = r"\p{L}\p{N}"
# the ASCII characters that a class leaves out, or holds: tested first, since a class of many ranges tests slowly
ASCII_OUTSIDE = {DIGITS: r"\x00-/:-\x7f", UPPER: r"\x00-@\[-\x7f"}
ASCII_INSIDE = {ALNUM + WS: "0-9A-Za-z "}


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def words(text: Column) -> Column:
    """White-space separated words; an empty array for blank text."""
    trimmed = strip(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"{SPACE}+")
    )


def word_count(text: Column) -> Column:
    return F.size(words(text))


def count_class(text: Column, body: str) -> Column:
    """Characters of ``text`` in the class ``[body]``.

    Dropping the runs outside the class and measuring what is left allocates one string per row instead
    of one per matching character.
    """
    return F.length(F.regexp_replace(text, _ascii_first(ASCII_OUTSIDE.get(body)) + f"[^{body}]+", ""))


def count_outside(text: Column, body: str) -> Column:
    """Characters of ``text`` outside the class ``[body]``."""
    return F.length(F.regexp_replace(text, _ascii_first(ASCII_INSIDE.get(body)) + f"[{body}]+", ""))


def _ascii_first(body: str | None) -> str:
    return f"[{body}]++|" if body else ""


def ratio(count: Column, text: Column) -> Column:
    """``count`` over the length of ``text``; 0 for empty text."""
    return F.when(F.length(text) > 0, count / F.length(text)).otherwise(
        F.when(text.isNotNull(), F.lit(0.0))
    )


def count_substring(text: Column, needle: str | Column) -> Column:
    """Non-overlapping occurrences of a literal; byte lengths are stored, so no character scan is needed."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    removed = F.octet_length(text) - F.octet_length(F.replace(text, needle))
    return (removed / F.octet_length(needle)).cast("int")


def after_bracket(raw: Column) -> Column:
    """Text after the first ``"] "``, or the whole line when there is none."""
    at = F.locate("] ", raw)
    return F.when(at > 0, F.substring(raw, at + 2, F.length(raw))).otherwise(raw)


def percent_one_decimal(share: Column) -> Column:
    """``0.8765 -> '87.7%'``, correctly rounded from the binary value, ties to even.

    ``format_string('%.1f')`` rounds the shortest decimal form instead, which differs on ties such as 70.05.
    The tie test is exact: both halves of the split fit a double after the multiplication.
    """
    x = share * F.lit(100.0)
    k = F.floor(x * 10)
    high = x.cast("float").cast("double")
    over = (high * 20 - (k * 2 + 1)) + (x - high) * 20
    up = (over > 0) | ((over == 0) & (k % 2 == 1))
    tenths = k + up.cast("bigint")
    return F.concat(
        F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%")
    )


def iso_time(ts: Column) -> Column:
    """ISO-8601 text, with the fraction only where there is one."""
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)),
    )
