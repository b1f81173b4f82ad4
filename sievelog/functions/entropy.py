"""Shannon entropy of the characters or words of one text, row-local.

Sorting the symbols puts equal ones next to each other; one pattern then reads off each run. That is
O(n log n) in the length of the text, needs no shuffle, and keeps a 20,000-word text inside its row.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sievelog.functions.text import strip, words


def _entropy(counts: Column, total: Column) -> Column:
    def add(acc, n):
        share = n / total
        return acc - share * F.log2(share)

    return F.aggregate(counts, F.lit(0.0), add)


def char_runs(text: Column) -> Column:
    """Runs of equal characters of the sorted, lower-cased text: one element per distinct character."""
    ordered = F.array_join(F.sort_array(F.split(F.lower(text), "")), "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(ordered, F.lit(r"(?s)((.)\2*+)"), F.lit(1))
    )


def word_runs(text: Column) -> Column:
    """Runs of equal words of the lower-cased text, each word closed by a line break."""
    ordered = F.array_join(F.sort_array(words(F.lower(text))), "\n")
    return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(
        F.regexp_extract_all(
            F.concat(ordered, F.lit("\n")), F.lit(r"(([^\n]++\n)(?:\2)*+)"), F.lit(1)
        )
    )


def run_word(run: Column) -> Column:
    return F.substring_index(run, "\n", 1)


def run_repeats(run: Column) -> Column:
    return (F.octet_length(run) / (F.octet_length(run_word(run)) + 1)).cast("int")


def with_entropy(df, message: str):
    """Add the entropy columns of ``message``.

    Counts and totals are projected before they are folded: inside a fold they would be recomputed per element.
    """
    text = F.col(message)
    df = df.withColumns({"_char_runs": char_runs(text), "_word_runs": word_runs(text)})
    df = df.withColumns(
        {
            "_char_counts": F.transform("_char_runs", lambda r: F.length(r)),
            "_word_counts": F.transform("_word_runs", run_repeats),
            "_word_lengths": F.transform(
                "_word_runs", lambda r: run_repeats(r).cast("bigint") * F.length(run_word(r))
            ),
        }
    )
    df = df.withColumns({"_chars": F.length(text), "_words": _total("_word_counts"), "_in_words": _total("_word_lengths")})
    return df.withColumns(
        {
            "char_entropy": _entropy(F.col("_char_counts"), F.col("_chars")),
            "word_entropy": _entropy(F.col("_word_counts"), F.col("_words")),
            "unique_chars": F.size("_char_counts"),
            "unique_words": F.size("_word_counts"),
            "avg_word_length": F.when(F.col("_words") > 0, F.col("_in_words") / F.col("_words")).otherwise(
                F.when(text.isNotNull(), F.lit(0.0))
            ),
        }
    ).drop(
        "_char_runs", "_word_runs", "_char_counts", "_word_counts", "_word_lengths", "_chars", "_words", "_in_words"
    )


def _total(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, n: acc + n)
