"""Bottom-k document fingerprints (DataFrame functions only).

A fingerprint is the sorted list of the ``k`` smallest distinct hashes of a text's shingles of five words. The
smallest hashes of a union are found among the smallest hashes of its parts, so fingerprints merge; the share of
common hashes among the ``k`` smallest of both texts estimates resemblance with a standard error of at most
``1 / (2 sqrt(k))``. A text with no more than ``k`` shingles is compared exactly.

Null and empty texts have the empty fingerprint; two empty fingerprints resemble each other fully, an empty and
another not at all. Equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from sievelog.llm import text as T

K = 256
WIDTH = 5


def fingerprint(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """Sorted array of the ``k`` smallest distinct shingle hashes of a text."""
    hashes = F.array_distinct(T.shingle_hashes(T.space_words(text), width))
    return F.slice(F.sort_array(hashes), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Fingerprint of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: Sequence[str], fp: str, k: int = K) -> DataFrame:
    """One fingerprint per group of any size. Ranks are cut in each task before rows move."""
    hashes = df.select(*keys, F.explode(fp).alias("_h"))
    rank = Window.partitionBy(*keys).orderBy("_h")
    least = hashes.withColumn("_r", F.dense_rank().over(rank)).where(F.col("_r") <= k)
    merged = least.groupBy(*keys).agg(F.sort_array(F.collect_set("_h")).alias(fp))
    empty = df.select(*keys).distinct()
    same = [empty[c].eqNullSafe(merged[c]) for c in keys]
    joined = empty.join(merged, same, "left")
    return joined.select(*[empty[c] for c in keys], F.coalesce(fp, F.array().cast("array<bigint>")).alias(fp))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets, 0 to 1."""
    of_union = T.bind(merge(a, b, k), lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(of_union)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated size of the shingle set; exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second holds, 0 to 1."""
    j = resemblance(a, b, k)
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    estimate = F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(estimate)


def encode(a: Column) -> Column:
    """A fingerprint as text: base64 of its hashes, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def add_cells(df: DataFrame, key: str, cells: int, name: str = "_cell") -> DataFrame:
    """Add the cell of a numeric key: at most ``cells`` stretches of about as many rows each, nulls lowest.

    The cut points come from one narrow job and are ``cells`` at most, whatever the number of rows.
    """
    value = F.coalesce(F.col(key).cast("double"), F.lit(float("-inf")))
    shares = [i / cells for i in range(1, cells)] or [0.5]
    found = df.select(F.percentile_approx(F.col(key).cast("double"), shares, 10 * cells + 1000).alias("c")).head()["c"]
    cuts = sorted(set(found or []))
    at = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_at", outputCol=name)
    if not cuts:
        return df.withColumn(name, F.lit(0))
    return at.transform(df.withColumn("_at", value)).withColumn(name, F.col(name).cast("int")).drop("_at")


def with_next(df: DataFrame, key: str, cells: int) -> tuple[DataFrame, Window]:
    """Rows keyed by ``_cell`` with a copy (``_copy``) of each cell's following row, and the window over a cell.

    The order is descending by ``key``, nulls last, and closes to a ring, so the last row is followed by the first.
    Rows that tie on the key follow in the order of their text's hash. Each row is moved once.
    """
    placed = add_cells(df, key, cells)
    # one row for each cell, at most ``cells``
    tops = sorted(placed.groupBy("_cell").agg(F.max(key).alias("top")).collect())
    ring = [(c, top, tops[(i + 1) % len(tops)][0]) for i, (c, top) in enumerate(tops)]
    edges = df.sparkSession.createDataFrame(ring, f"_cell int, _top {dict(df.dtypes)[key]}, _to int")
    own = F.struct(F.col("_cell").alias("cell"), F.lit(False).alias("copy"))
    copied = F.struct(F.col("_to").alias("cell"), F.lit(True).alias("copy"))
    at = F.explode(F.when(F.col(key).eqNullSafe(F.col("_top")), F.array(own, copied)).otherwise(F.array(own)))
    rows = placed.join(F.broadcast(edges), "_cell").withColumn("_at", at)
    rows = rows.select(*df.columns, F.col("_at.cell").alias("_cell"), F.col("_at.copy").alias("_copy"))
    order = Window.partitionBy("_cell").orderBy("_copy", F.col(key).desc_nulls_last(), "_tie")
    return rows, order


def edited_fingerprints(documents: DataFrame, k: int = K, cells: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last half is the next document's beginning.

    The next document is the one below in ``doc_id``; the lowest is followed by the highest, a single document by
    itself. Null texts are empty, null ids come last. One row per input row.
    """
    cells = cells or 4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select("doc_id", T.whole(F.col("text")).alias("text"))
    docs = docs.withColumn("_tie", F.xxhash64("text"))
    rows, order = with_next(docs, "doc_id", cells)
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("_next", F.lead("text").over(order))
    rows = rows.withColumns({"n_chars": F.char_length("text").cast("long"), "_half": half})
    rows = rows.withColumn(
        "_edited",
        F.concat(
            F.substring("text", F.lit(1), (F.col("n_chars") - F.col("_half")).cast("int")),
            F.substring(F.coalesce("_next", F.lit("")), F.lit(1), F.col("_half")),
        ),
    )
    rows = rows.select(
        "doc_id", "_cell", "_copy", "_tie", "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text"), k).alias("_own"),
        F.when(~F.col("_copy"), fingerprint(F.col("_edited"), k)).alias("_other"),
    )
    rows = rows.withColumn("_following", F.lead("_own").over(order)).where("not _copy")
    own, other, following = F.col("_own"), F.col("_other"), F.col("_following")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        encode(own).alias("fingerprint"),
        encode(other).alias("edited_fingerprint"),
        resemblance(own, other, k).alias("near_edited"),
        resemblance(own, following, k).alias("near_next"),
        distinct_shingles(own, k).alias("n_shingles_estimate"),
    )
