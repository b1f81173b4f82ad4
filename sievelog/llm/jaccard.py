"""Exact n-gram Jaccard join by a token-group matrix.

Documents with 100 * common >= 85 * all shingles of four words are linked; the result is the connected component of
every document. Equal sets collapse first. Shingles are ordered by the frequency of their rarest word, then by hash,
with frequent shingles behind all others, and two linked sets share a shingle among the first 15 % of either, so only sets that meet there are looked at.

1. *Stars*: where sets meet, each is held against the one that has the fewest unshared shingles. That joins most of a
   large group of copies with one comparison per member, and so forms the groups.
2. *Matrix*: the sets are partitioned into groups of similar ones, at most about ``GROUP`` of a component found so far,
   and each group keeps the union of its members' whole sets. A set is weighed against a whole group: if it shares too
   few shingles with the union, no member can be linked to it. Only the qualifying groups are opened and their members
   compared. Sets already in one component are never compared again.

Before any set moves, overlaps are bounded by *counts*: the number of a set's shingles in each of ``n / 4`` to ``n / 2``
hash buckets, one byte each. Summed minima of two sets' counts are at least what they share, and of a set's counts and
the largest ones in a group at least what it shares with any member. What this leaves is weighed against the union itself.

No link is lost: a pair is skipped only if it is already connected or if a bound excludes it.

Words are runs of anything but ASCII white space, lower-cased in A-Z. A text of fewer than four words has one shingle,
a null, empty or blank text has none and is linked with nothing. Rows with a null ``doc_id`` stand alone; repeated ids
get the component of each of their texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from sievelog.llm import text as T
from sievelog.llm.components import components
from sievelog.operators.lookup import spread_lookup
from sievelog.session import ship_package, written

WIDTH, PERCENT = 4, 85
COMMON = 1 << 20
WORD_BUCKETS, SHINGLE_BUCKETS = 1 << 20, 1 << 18
GROUP = 64
BATCH_WORDS = 400_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(values: np.ndarray, sizes: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of several texts at once: (text, shingle, first word), from all texts' word hashes and word counts."""
    words = values.view(np.uint64)
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(words))
    whole = at + width <= ends[text]
    first = at[whole]
    h = np.zeros(len(first), np.uint64)
    for k in range(width):
        h += words[first + k] * _MIX[k % 4] * np.uint64(2 * (k // 4) + 1)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    begin = ends[short] - sizes[short]
    g = sizes[short].astype(np.uint64) * _MIX[0]
    for k in range(width - 1):
        live = sizes[short] > k
        g[live] += words[begin[live] + k] * _MIX[(k + 1) % 4]
    return (
        np.concatenate([text[whole], short]),
        np.concatenate([_scramble(h), _scramble(g ^ _MIX[3])]).view(np.int64),
        np.concatenate([first, begin]),
    )


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of a batch of about ``BATCH_WORDS`` words: (from row, to row, words, sizes)."""
    lists = batch.column(column)
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    row = 0
    while row < len(sizes):
        before = ends[row] - sizes[row]
        to = max(row + 1, int(np.searchsorted(ends, before + BATCH_WORDS, side="right")))
        flat = lists.slice(row, to - row).flatten()
        yield row, to, flat.to_numpy(zero_copy_only=False).astype(np.int64, copy=False), sizes[row:to]
        row = to


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of ``n`` must share with any linked set."""
    return -(-percent * n // 100)


def bucket_counts(text: np.ndarray, shingle: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """Shingles of each text by hash bucket, a byte each. None without shingles, or if a bucket holds more than a byte can."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(n, 1) / 4)), 0).astype(np.uint64)
    size = np.left_shift(np.uint64(1), bits).astype(np.int64)
    ends = np.cumsum(size)
    # a shift by all 64 bits is none, so halve first
    bucket = ((shingle.view(np.uint64) >> np.uint64(1)) >> (np.uint64(63) - bits[text])).astype(np.int64)
    counts = np.bincount((ends - size)[text] + bucket, minlength=int(ends[-1]) if len(ends) else 0)
    fits = np.maximum.reduceat(counts, ends - size) <= 255 if len(ends) else []
    narrow = counts.astype(np.uint8)
    return [narrow[e - k : e].tobytes() if ok and x else None for e, k, ok, x in zip(ends, size, fits, n)]


def folded(counts: np.ndarray, size: int) -> np.ndarray:
    """Counts in fewer buckets; neighbouring ones are added."""
    return counts.reshape(size, -1).sum(1) if len(counts) > size else counts


def most_shared(a: bytes | None, b: bytes | None) -> float:
    """At least what two sets, or a set and any member of a group, share."""
    if a is None or b is None:
        return np.inf
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return float(np.minimum(folded(x.astype(np.int64), size), folded(y.astype(np.int64), size)).sum())


def largest_counts(members: list[bytes | None]) -> bytes | None:
    """Of each bucket the most shingles that a member has there; none if any member has no counts."""
    if any(m is None for m in members):
        return None
    size = min(map(len, members))
    most = np.max([folded(np.frombuffer(m, np.uint8).astype(np.int64), size) for m in members], axis=0)
    return most.astype(np.uint8).tobytes() if most.max() <= 255 else None


def frequencies(hashed: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of words and of frequent shingles by hash bucket, which fix the global order of shingles.

    Of the words those above a frequency that at most ``COMMON`` buckets can reach are kept, of the shingles those in
    buckets that stand out from an even spread; all others count as 0. So both are short, whatever the documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_counts, shingle_counts = np.zeros(WORD_BUCKETS, np.int64), np.zeros(SHINGLE_BUCKETS, np.int64)
        for batch in batches:
            for _, _, words, sizes in _parts(batch, "words"):
                word_counts += np.bincount(words & (WORD_BUCKETS - 1), minlength=WORD_BUCKETS)
                _, shingle, _ = shingle_sets(words, sizes, width)
                shingle_counts += np.bincount(_shingle_bucket(shingle), minlength=SHINGLE_BUCKETS)
        for kind, counts in enumerate((word_counts, shingle_counts)):
            bucket = np.flatnonzero(counts)
            columns = [np.full(len(bucket), kind, np.int32), bucket.astype(np.int32), counts[bucket]]
            yield pa.record_batch([pa.array(c) for c in columns], ["kind", "bucket", "n"])

    counts = hashed.mapInArrow(run, "kind int, bucket int, n long").groupBy("kind", "bucket").agg(F.sum("n").alias("n"))
    counts = written(counts, "frequencies")
    total = dict(counts.groupBy("kind").agg(F.sum("n")).collect())
    mean = total.get(1, 0) / SHINGLE_BUCKETS
    least = (total.get(0, 0) // COMMON, int(mean + 8 * mean**0.5 + 32))
    found = counts.where(F.col("n") > F.when(F.col("kind") == 0, F.lit(least[0])).otherwise(F.lit(least[1]))).toArrow()
    out = []
    for kind, size in enumerate((WORD_BUCKETS, SHINGLE_BUCKETS)):
        part = found.filter(pc.equal(found["kind"], kind))
        dense = np.zeros(size, np.int64)
        dense[part["bucket"].to_numpy()] = part["n"].to_numpy()
        out.append(dense)
    return out[0], out[1]


def _shingle_bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle.view(np.uint64) >> np.uint64(64 - SHINGLE_BUCKETS.bit_length() + 1)).astype(np.int64)


def prefixes(hashed: DataFrame, percent: int, width: int) -> DataFrame:
    """(id, n, digest, counts, prefix): set size, digest, bucket counts and the first shingles in the global order."""
    ship_package(hashed.sparkSession)
    held = hashed.sparkSession.sparkContext.broadcast(frequencies(hashed, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_counts, shingle_counts = held.value
        for batch in batches:
            for row, to, words, sizes in _parts(batch, "words"):
                frequency = word_counts[words & (WORD_BUCKETS - 1)]
                text, shingle, first = shingle_sets(words, sizes, width)
                last = np.cumsum(sizes)[text] - 1
                rarest = frequency[first]
                for k in range(1, width):
                    rarest = np.minimum(rarest, frequency[np.minimum(first + k, last)])
                order = np.lexsort((shingle, rarest, shingle_counts[_shingle_bucket(shingle)], text))
                text, shingle = text[order], shingle[order]
                fresh = np.ones(len(text), bool)
                fresh[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
                text, shingle = text[fresh], shingle[fresh]
                n = np.bincount(text, minlength=len(sizes))
                begin = np.cumsum(n) - n
                take = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
                inside = np.arange(len(text)) - begin[text] < take[text]
                digests = [
                    hashlib.blake2b(np.sort(shingle[b : b + k]).tobytes(), digest_size=16).digest() for b, k in zip(begin, n)
                ]
                offsets = pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32())
                yield pa.record_batch(
                    [
                        batch.column("id").slice(row, to - row),
                        pa.array(n, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(bucket_counts(text, shingle, n), pa.binary()),
                        pa.ListArray.from_arrays(offsets, pa.array(shingle[inside], pa.int64())),
                    ],
                    ["id", "n", "digest", "counts", "prefix"],
                )

    return hashed.mapInArrow(run, "id long, n long, digest binary, counts binary, prefix array<bigint>")


def sets_of(hashed: DataFrame, width: int) -> DataFrame:
    """(id, tokens): each row's sorted distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, to, words, sizes in _parts(batch, "words"):
                text, shingle, _ = shingle_sets(words, sizes, width)
                order = np.lexsort((shingle, text))
                text, shingle = text[order], shingle[order]
                fresh = np.ones(len(text), bool)
                fresh[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
                n = np.bincount(text[fresh], minlength=len(sizes))
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.record_batch(
                    [batch.column("id").slice(row, to - row), pa.ListArray.from_arrays(offsets, pa.array(shingle[fresh], pa.int64()))],
                    ["id", "tokens"],
                )

    return hashed.mapInArrow(run, "id long, tokens array<bigint>")


def _needed(x: str, y: str, percent: int):
    """Shared shingles that sets of these sizes need: ceil(percent (x + y) / (100 + percent))."""
    return F.ceil(F.lit(percent) * (F.col(x) + F.col(y)) / F.lit(100 + percent) - 1e-9)


def _close(x: str, y: str, percent: int):
    """Sizes that allow a link."""
    return (F.lit(percent) * F.col(x) <= F.lit(100) * F.col(y)) & (F.lit(percent) * F.col(y) <= F.lit(100) * F.col(x))


def _enough(shared, x: str, px: str, y: str, py: str, percent: int):
    """Whether sets that share this many prefix shingles can be linked.

    Of the two, the one whose prefix ends first shares none of it beyond the other's prefix, so what it shares is at
    most the shared prefix shingles and all of its own rest.
    """
    rest = F.greatest(F.col(x) - F.col(px), F.col(y) - F.col(py))
    return shared + rest >= _needed(x, y, percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ta", "tb"))
    sized = joined.select("a", "b", common.alias("c"), (F.size("ta") + F.size("tb")).alias("s"))
    return sized.where(100 * F.col("c") >= percent * (F.col("s") - F.col("c"))).select("a", "b").distinct()


def plausible(pairs: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose counts allow the similarity. ``counts`` has (id, n, counts)."""
    left = counts.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    right = counts.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return _allowed(joined.withColumn("need", _needed("na", "nb", percent)), "ca", "cb").select("a", "b")


def _allowed(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rows whose two counts allow the shared shingles of column ``need``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            need = batch.column("need").to_pylist()
            good = [most_shared(*both) >= k for *both, k in zip(batch.column(x).to_pylist(), batch.column(y).to_pylist(), need)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def _hashed(texts: DataFrame) -> DataFrame:
    return texts.select("id", T.word_hashes(T.space_words(F.col("text"))).alias("words"))


def _involved(texts: DataFrame, ids: DataFrame, width: int, small: int = 1 << 20) -> DataFrame:
    """Sets of the listed documents. Up to ``small`` ids are sent to the texts, else the texts move."""
    ids = written(ids.distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= small else ids
    return written(sets_of(_hashed(texts.join(wanted, "id", "left_semi")), width), "sets")


def star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Each set with the one of fewest unshared prefix shingles among those it meets at each of its shingles."""
    centre = shared.groupBy("token", "band").agg(F.min(F.struct("solo", "id", "n", "p")).alias("c"))
    met = shared.join(centre, ["token", "band"]).where(F.col("id") != F.col("c.id"))
    met = met.select("id", "n", "p", F.col("c.id").alias("b"), F.col("c.n").alias("nb"), F.col("c.p").alias("pb"))
    met = met.groupBy("id", "b").agg(F.count(F.lit(1)).alias("k"), *[F.first(x).alias(x) for x in ("n", "p", "nb", "pb")])
    met = met.where(_close("n", "nb", percent) & _enough(F.col("k"), "n", "p", "nb", "pb", percent))
    return met.select(F.col("id").alias("a"), "b")


def partition_groups(nodes: DataFrame, group: int, salts: int) -> DataFrame:
    """Add ``group``: at most about ``group`` sets of one component and of similar size.

    A component of any size is cut by a hash into parts, so none is gathered.
    """
    sizes = nodes.groupBy("component", "band").agg(F.count(F.lit(1)).alias("members"))
    cut = spread_lookup(nodes, ["component", "band"], sizes, ["id"], salts=salts)
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / F.lit(group)))
    return cut.withColumn("group", F.xxhash64("component", "band", part)).drop("members")


def qualifying_groups(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(id, g, k, n, p): the sets and the groups of other components that the bound leaves open.

    The matrix has a row for each shingle and group in whose union it is. A set is counted against a whole group, once
    per shingle; the set of the smaller component is the query.
    """
    rows = shared.select("token", "id").join(nodes, "id")
    matrix = rows.groupBy("token", "group").agg(
        F.first("component").alias("gc"), F.first("weight").alias("gw"),
        F.first("low").alias("low"), F.first("high").alias("high"),
    )
    # shingles that meet in one component only link nothing new
    spread = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    rows = rows.join(spread.select("token"), "token", "left_semi")
    matrix = matrix.join(spread.select("token"), "token", "left_semi")
    order = F.struct(F.col("weight"), F.col("component")) < F.struct(F.col("gw"), F.col("gc"))
    sized = (F.lit(percent) * F.col("n") <= F.lit(100) * F.col("high")) & (F.lit(percent) * F.col("low") <= F.lit(100) * F.col("n"))
    queries = rows.select("token", "id", "n", "p", "component", "weight")
    met = queries.join(matrix.withColumnRenamed("group", "g"), "token").where(order & sized)
    met = met.groupBy("id", "g").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"), F.first("p").alias("p"))
    rest = F.max(F.col("n") - F.col("p")).alias("rest")
    # a group is bounded, and so are its members' counts
    bounds = nodes.groupBy(F.col("group").alias("g")).agg(rest, F.min("n").alias("least"), F.collect_list("held").alias("members"))
    smallest = F.greatest("least", F.ceil(F.lit(percent) * F.col("n") / 100))
    open_ = F.col("k") + F.greatest(F.col("n") - F.col("p"), F.col("rest")) >= F.col("need")
    # only groups that are asked have their counts summed up
    asked = bounds.join(met.select("g").distinct(), "g", "left_semi")
    met = met.join(_group_counts(asked), "g").join(nodes.select("id", F.col("held.counts").alias("counts")), "id")
    met = met.withColumn("smallest", smallest).withColumn("need", _needed("n", "smallest", percent)).where(open_)
    return _allowed(met.select("id", "g", "k", "n", "p", "need", "counts", "most"), "counts", "most").drop("most")


def _group_counts(bounds: DataFrame) -> DataFrame:
    """Replace ``members`` by ``most``: of each bucket the most shingles of a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [largest_counts([m["counts"] for m in row]) for row in batch.column("members").to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in ("g", "rest", "least")), pa.array(most, pa.binary())], ["g", "rest", "least", "most"])

    return bounds.select("g", "rest", "least", "members").mapInArrow(run, "g long, rest long, least long, most binary")


def weighed(open_groups: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """The (id, g) whose set shares enough with the union of the group's sets."""
    named = open_groups.select("g").distinct()
    members = nodes.select(F.col("group").alias("g"), "id").join(named, "g", "left_semi").join(sets, "id")
    unions = members.groupBy("g").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("union"))
    met = open_groups.join(sets, "id").join(unions, "g")
    return met.where(F.size(F.array_intersect("tokens", "union")) >= F.col("need")).select("id", "g", "k", "n", "p", "counts")


def opened_pairs(open_groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a set and a member of one of its open groups that the bounds allow."""
    members = nodes.select(
        F.col("group").alias("g"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("held.counts").alias("most")
    )
    may = _close("n", "nb", percent) & _enough(F.col("k"), "n", "p", "nb", "pb", percent)
    met = open_groups.join(members, "g").where(may).withColumn("need", _needed("n", "nb", percent))
    met = met.select(F.col("id").alias("a"), "b", "need", "counts", "most")
    return _allowed(met, "counts", "most").select("a", "b").distinct()


def join_components(documents: DataFrame, percent: int = PERCENT, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """Per document: (doc_id, n_shingles, component_id)."""
    spark = documents.sparkSession
    ship_package(spark)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    every = written(prefixes(_hashed(texts), percent, width), "prefixes")

    # one set of each digest
    reps = every.where("n > 0 and id is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("counts").alias("counts"), F.first("prefix").alias("prefix")
    )
    reps = written(reps, "sets")
    postings = reps.select("id", "n", F.size("prefix").alias("p"), F.explode("prefix").alias("token"))
    met = postings.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    shared = written(postings.join(met, "token", "left_semi"), "shared")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(percent / 100)))).cast("int")
    counted = shared.groupBy("id").agg((F.first("p") - F.count(F.lit(1))).alias("solo"))
    shared = shared.withColumn("band", band)

    counts = reps.select("id", "n", "counts")
    stars = written(plausible(star_pairs(shared.join(counted, "id"), percent), counts, percent), "stars")
    involved = stars.select(F.explode(F.array("a", "b")).alias("id"))
    links = written(verified(stars, _involved(texts, involved, width), percent), "links")
    first = components(links)

    nodes = shared.groupBy("id").agg(*[F.first(x).alias(x) for x in ("n", "p", "band")])
    nodes = nodes.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    base = F.lit(100 / percent)
    nodes = nodes.withColumns({"low": F.floor(F.pow(base, F.col("band")) * 0.999), "high": F.ceil(F.pow(base, F.col("band") + 1) * 1.001)})
    weight = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    nodes = spread_lookup(nodes, ["component"], weight, ["id"], salts=salts)
    nodes = partition_groups(nodes, group, salts).join(counts.select("id", F.struct("counts").alias("held")), "id")
    nodes = written(nodes, "groups")
    open_groups = written(qualifying_groups(shared, nodes, percent), "open")
    inside = nodes.join(open_groups.select(F.col("g").alias("group")).distinct(), "group", "left_semi").select("id")
    sets = _involved(texts, inside.unionByName(open_groups.select("id")), width)
    pairs = written(opened_pairs(weighed(open_groups, nodes, sets), nodes, percent), "pairs")
    more = written(verified(pairs, sets, percent), "links")
    linked = components(links.unionByName(more))

    named = reps.select("digest", F.col("id").alias("rep"))
    rows = every.select("id", "n", "digest")
    rows = spread_lookup(rows.where("n > 0"), ["digest"], named, ["id"], salts=salts).unionByName(
        rows.where("n = 0").withColumn("rep", F.col("id"))
    )
    linked = linked.select(F.col("id").alias("rep"), "component")
    out = spread_lookup(rows, ["rep"], linked, ["id"], salts=salts)
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id")
    )
