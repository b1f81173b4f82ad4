"""Benchmark decontamination by winnowing (DataFrame functions only).

A window of ten words holds six runs of five words; the run with the smallest hash is the window's fingerprint, and
neighbouring windows mostly share theirs. Equal windows have equal fingerprints at equal places, so every span of ten
words that a document shares with a benchmark item meets in a fingerprint. A meeting is extended to the windows that
can hold it, and their words are compared, so no other span is reported. Items of fewer than ten words are one window
of their own length; all runs of those few lengths are hashed.

Documents without words have no hits. Items without words have no windows. Rows that share a ``doc_id`` but not the
text are judged apart. A null ``item_id`` marks its words in documents but is not counted or listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievelog.llm import text as T
from sievelog.session import written

WINDOW, RUN = 10, 5
SLOTS = WINDOW - RUN + 1
BROADCAST_WINDOWS = 200_000


def _window_marks(words: Column) -> Column:
    """Per window of ten words: hash of its smallest run, the run's place in the low three bits."""

    def marks(g: Column) -> Column:
        return F.transform(
            F.slice(g, 1, F.greatest(F.size(g) - (SLOTS - 1), F.lit(0))),
            lambda x, i: F.least(x, *[g[i + k] + k for k in range(1, SLOTS)]),
        )

    runs = F.transform(T.shingle_hashes(words, RUN), lambda x: F.shiftleft(F.shiftright(x, 3), 3))
    return F.when(F.size(words) >= WINDOW, T.bind(runs, marks)).otherwise(F.array().cast("array<bigint>"))


def _fresh(marks: Column) -> Column:
    """The marks, null where the window before has the same run."""
    return T.bind(
        marks,
        lambda m: F.transform(
            m,
            lambda x, i: F.when(
                (i == 0) | (x.bitwiseAND(F.lit(7)) + 1 != m[F.greatest(i - 1, F.lit(0))].bitwiseAND(F.lit(7))), x
            ),
        ),
    )


def _runs_of(words: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the items: (item_id, window, length, mark); mark is null for windows of short items."""
    items = benchmark.select("item_id", T.letter_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    long = items.where(n >= WINDOW).select("item_id", "words", F.posexplode(_window_marks(F.col("words"))).alias("i", "mark"))
    long = long.select("item_id", _runs_of(F.col("words"), F.col("i"), WINDOW).alias("window"), F.lit(WINDOW).alias("length"), "mark")
    short = items.where(n < WINDOW).select(
        "item_id", F.array_join("words", " ").alias("window"), n.alias("length"), F.lit(None).cast("long").alias("mark")
    )
    return long.unionByName(short)


def find_hits(documents: DataFrame, windows: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Occurrences of distinct windows: (key, start, length, window), key being (doc_id, hash of the text).

    Up to ``broadcast_windows`` windows all runs of a document are looked up among the fingerprints where it is read. Beyond, only
    (key, place, hash) moves to the benchmark's fingerprints and the found places move back to their documents.
    """
    counted = {r["length"]: r["n"] for r in windows.groupBy("length").agg(F.countDistinct("window").alias("n")).collect()}
    small = sum(counted.values()) <= broadcast_windows
    hint = F.broadcast if small else (lambda df: df)
    docs = keyed(documents)
    distinct = windows.select("window", "length", "mark").distinct()

    found = []
    if WINDOW in counted:
        seeds = distinct.where("mark is not null").select(F.shiftleft(F.shiftright("mark", 3), 3).alias("hash")).distinct()
        # the runs are a column of their own: a plain column is exploded inside generated code, which copies no words
        if small:
            # every run is looked up: that costs less than finding which of them are marks
            runs = F.when(F.size("words") >= WINDOW, T.shingle_hashes(F.col("words"), RUN))
            marked = docs.select("key", "words", runs.alias("runs")).select("key", "words", F.posexplode("runs").alias("at", "m"))
            marked = marked.select("key", "words", "at", F.shiftleft(F.shiftright("m", 3), 3).alias("hash"))
        else:
            marked = docs.select("key", _fresh(_window_marks(F.col("words"))).alias("marks"))
            marked = marked.select("key", F.posexplode("marks").alias("i", "m")).where("m is not null").select(
                "key",
                (F.col("i") + F.col("m").bitwiseAND(F.lit(7)).cast("int")).alias("at"),
                F.shiftleft(F.shiftright("m", 3), 3).alias("hash"),
            )
        met = marked.join(hint(seeds), "hash", "inner" if small else "left_semi")
        if not small:
            places = met.groupBy("key").agg(F.collect_list("at").alias("places"))
            met = docs.join(places, "key").select("key", "words", F.explode("places").alias("at"))
        starts = met.select("key", "words", F.explode(F.sequence(F.col("at") - (SLOTS - 1), F.col("at"))).alias("start"))
        starts = starts.where((F.col("start") >= 0) & (F.col("start") <= F.size("words") - WINDOW))
        around = starts.select("key", "start", F.lit(WINDOW).alias("length"), _runs_of(F.col("words"), F.col("start"), WINDOW).alias("window"))
        found.append(around.join(hint(distinct.where(F.col("length") == WINDOW).select("window").distinct()), "window", "left_semi"))
    # at most nine lengths
    for length in sorted(set(counted) - {WINDOW}):
        short = distinct.where(F.col("length") == length).select("window")
        runs = F.transform(
            F.sequence(F.lit(0), F.size("words") - length), lambda i: _runs_of(F.col("words"), i, length)
        )
        placed = docs.where(F.size("words") >= length).select("key", F.posexplode(runs).alias("start", "window"))
        placed = placed.select("key", "start", F.lit(length).alias("length"), "window")
        found.append(placed.join(hint(short), "window", "left_semi"))
    if not found:
        empty = docs.select("key", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("window"))
        return empty.where("false")
    out = found[0].select("key", "start", "length", "window")
    for other in found[1:]:
        out = out.unionByName(other.select("key", "start", "length", "window"))
    return out


def keyed(documents: DataFrame) -> DataFrame:
    """Documents as (key, words)."""
    key = F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h"))
    return documents.select(key.alias("key"), T.letter_words(F.col("text")).alias("words"))


def contamination(documents: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: words, hit words, items met and their ids, and whether any word is hit."""
    windows = benchmark_windows(benchmark)
    hits = find_hits(documents, windows, broadcast_windows)
    # one pass over the hits; the items of a document's windows are looked up from there
    found = hits.groupBy("key").agg(
        F.collect_set(F.struct("start", "length")).alias("spans"), F.collect_set("window").alias("windows")
    )
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["length"] - 1)))
    found = found.select("key", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.explode("windows").alias("window"))
    owners = windows.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("item")).distinct()
    met = found.join(owners, "window", "left").groupBy("key").agg(
        F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items")
    )

    docs = documents.select(
        F.struct(F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("h")).alias("key"),
        F.size(T.letter_words(F.col("text"))).cast("long").alias("n_words"),
    )
    out = docs.join(met, "key", "left")
    zero, n_hit = F.lit(0).cast("long"), F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("key.doc_id").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_hits(documents: DataFrame, benchmark: DataFrame, small: int = 1 << 20) -> DataFrame:
    """Documents that hold no window of any item, with all their columns."""
    found = written(find_hits(documents, benchmark_windows(benchmark)).select("key").distinct(), "hits")
    found = F.broadcast(found) if found.count() <= small else found
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    key = F.struct(F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("h")).alias("key")
    return documents.select(row).select("row", key).join(found, "key", "left_anti").select("row.*")
