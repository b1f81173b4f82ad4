"""TF-IDF over messages, and rare words.

Messages are split into words by Spark; the words and pairs of a task are counted in Arrow functions, which hand back
sums per term, at most ``HELD`` terms at a time, that are combined again before and after they are shuffled. A pair is
no more frequent than either of its words, so once the words are counted only pairs of words that are frequent enough
for the vocabulary are counted at all.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence, Set
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sievelog.functions.entropy import run_word, word_runs
from sievelog.functions.text import WORD
from sievelog.session import ship_package, written

HELD = 400_000


def default_stop_words() -> list[str]:
    return sorted(set(StopWordsRemover.loadDefaultStopWords("english")))


def tokens_of(message: Column, stop_words: Sequence[str]) -> Column:
    """Lower-cased words of two or more word characters without stop words."""
    tokens = F.regexp_extract_all(F.lower(message), F.lit(f"({WORD}{{2,}})"), F.lit(1))
    if stop_words:
        tokens = _without(tokens, stop_words)
    return tokens


def _without(tokens: Column, stop_words: Sequence[str]) -> Column:
    listed = [w.lower() for w in stop_words]
    return F.filter(tokens, lambda t: ~t.isin(*listed))


def _words(joined: str) -> list[str]:
    return joined.split("\n") if joined else []


def _pairs(words: list[str], among: Set[str] | None = None) -> list[str]:
    """Pairs of neighbouring words, both of them in ``among``."""
    if among is None:
        return [f"{a} {b}" for a, b in zip(words, words[1:])]
    known = [w if w in among else None for w in words]
    return [f"{a} {b}" for a, b in zip(known, known[1:]) if a and b]


def _lines(message: str, stop_words: Sequence[str]) -> Column:
    """The words of a message one to a line, as no word holds a line break."""
    joined = F.array_join(tokens_of(F.col(message), stop_words), "\n")
    return F.coalesce(joined, F.lit("")).alias("lines")


def _totals(lines: DataFrame, terms_of: Callable[[str], list[str]]) -> DataFrame:
    """``(term, count, df)``: occurrences of each term and the messages that hold it."""
    ship_package(lines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, holders = Counter(), Counter()

        def sums() -> Iterator[pa.RecordBatch]:
            columns = [pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())]
            columns.append(pa.array([holders[t] for t in counts], pa.int64()))
            whole = pa.record_batch(columns, ["term", "count", "df"])
            for at in range(0, whole.num_rows, 10_000):
                yield whole.slice(at, 10_000)

        for batch in batches:
            for text in batch.column(0):
                terms = terms_of(text.as_py())
                counts.update(terms)
                holders.update(set(terms))
                if len(counts) >= HELD:
                    yield from sums()
                    counts.clear()
                    holders.clear()
        if counts:
            yield from sums()

    parts = lines.mapInArrow(run, "term string, count bigint, df bigint")
    return parts.groupBy("term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))


@dataclass(frozen=True)
class TfIdf:
    """A fitted vocabulary: ``term``, ``count``, ``df``, ``idf``; at most ``max_features`` rows."""

    vocabulary: DataFrame
    stop_words: tuple[str, ...]
    max_features: int


def fit_tfidf(
    df: DataFrame,
    message: str = "message",
    max_features: int = 1000,
    min_df: int = 2,
    max_df: float = 0.8,
    stop_words: Sequence[str] | None = None,
) -> TfIdf:
    """Terms in at least ``min_df`` messages and at most the share ``max_df``, the most frequent first.

    Ties at the cut-off go to the alphabetically smaller term. Words are counted here, pairs when the vocabulary is used.
    """
    stop_words = default_stop_words() if stop_words is None else list(stop_words)
    lines = df.select(_lines(message, stop_words))
    n = df.count()
    allowed = (F.col("df") >= min_df) & (F.col("df") <= max_df * n)
    words = written(_totals(lines, _words), "words")
    among = _frequent(words, allowed, max_features)
    totals = words.unionByName(_totals(lines, lambda joined: _pairs(_words(joined), among)))
    vocabulary = (
        totals.where(allowed)
        .orderBy(F.desc("count"), "term")
        .limit(max_features)
        .select("term", "count", "df", (F.log((n + F.lit(1)) / (F.col("df") + 1)) + 1).alias("idf"))
    )
    return TfIdf(vocabulary, tuple(stop_words), max_features)


def _frequent(words: DataFrame, allowed: Column, max_features: int) -> frozenset[str] | None:
    """Words as frequent as the last one that words alone would put into the vocabulary.

    None, for all, where they do not fill it or where words too rare or common in messages make these too many.
    """
    chosen = words.where(allowed).orderBy(F.desc("count"), "term").limit(max_features)
    last = chosen.agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).head()
    if last["n"] < max_features or not max_features:
        return None
    most = 4 * max_features
    found = words.where(F.col("count") >= last["least"]).select("term").limit(most + 1).collect()
    return frozenset(r["term"] for r in found) if len(found) <= most else None


def tfidf_weights(df: DataFrame, model: TfIdf, key: str, message: str = "message") -> DataFrame:
    """``(key, term, tfidf)``: the non-zero, length-normalised weights of each message.

    The vocabulary is read here and sent with the tasks: its size is bounded by ``max_features``. Each message leaves
    its task as one record holding its own weights, which is as large as the result itself; messages that share a key
    are normalised together.
    """
    ship_package(df.sparkSession)
    idf = {r["term"]: r["idf"] for r in model.vocabulary.select("term", "idf").collect()}
    paired = {w for t in idf for w in t.split(" ") if " " in t}
    terms_kind = T.ArrayType(T.StructType().add("term", "string").add("w", "double"))
    kind = T.StructType([df.select(key).schema[0]]).add("terms", terms_kind).add("square", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ends, terms, weights, squares = [], [0], [], [], []
            for row, text in enumerate(batch.column(1)):
                words = _words(text.as_py())
                found = Counter(t for t in words + _pairs(words, paired) if t in idf)
                if found:
                    own = [n * idf[t] for t, n in found.items()]
                    terms.extend(found)
                    weights.extend(own)
                    rows.append(row)
                    ends.append(len(terms))
                    squares.append(math.fsum(w * w for w in own))
            pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(weights, pa.float64())], ["term", "w"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([keys, lists, pa.array(squares, pa.float64())], [key, "terms", "square"])

    lines = df.select(key, _lines(message, model.stop_words))
    per_message = lines.mapInArrow(run, kind).groupBy(key).agg(
        F.flatten(F.collect_list("terms")).alias("terms"), F.sqrt(F.sum("square")).alias("norm")
    )
    return per_message.select(key, F.explode("terms").alias("t"), "norm").select(
        key, F.col("t.term").alias("term"), (F.col("t.w") / F.col("norm")).alias("tfidf")
    )


def rare_words(df: DataFrame, key: str, message: str = "message", max_df: int = 2) -> DataFrame:
    """``(key, rare_words)``: distinct words of each message that occur in at most ``max_df`` messages, one or two.

    ``key`` is unique. Up to two messages of a word are its least and greatest key, so an aggregate of three values per
    word, combined before it moves, both counts the messages and names them; a word that is everywhere is one row of
    each task. Texts are split into words once, and the messages without rare words come from the keys alone.
    """
    if max_df not in (1, 2):
        raise ValueError("the least and the greatest key name at most two messages")
    words = df.select(key, F.explode(word_runs(F.col(message))).alias("run")).select(
        F.col(key).alias("k"), run_word(F.col("run")).alias("word")
    )
    named = words.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.min("k").alias("a"), F.max("k").alias("b"))
    holders = F.when(F.col("df") == 1, F.array("a")).otherwise(F.array("a", "b"))
    one = named.where(F.col("df") <= max_df).select(F.explode(holders).alias(key), F.lit(1).cast("bigint").alias("n"))
    none = df.select(key, F.lit(0).cast("bigint").alias("n"))
    return one.unionByName(none).groupBy(key).agg(F.sum("n").alias("rare_words"))
