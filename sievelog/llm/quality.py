"""Perplexity under an interpolated modified Kneser-Ney model of trusted text, and language-specific thresholds.

The model counts runs of up to five characters in the trusted documents of each language. Counts, continuation counts,
context totals and the probabilities of each order are tables joined on (language, run) or (language, context), so the
model grows with the trusted text and is built in shards. The units are characters, white space taken as one space:
the tables of word runs that documents meet would exceed the documents themselves.

A document's perplexity is taken under its own language's model; one without a language, or of a language without
trusted text, is given the least over all models. A document is kept unless its perplexity is above a quantile of the
trusted documents of its language that were left out of training: the one of ``QUANTILES`` that keeps most of them and
catches most documents labelled 0 (the sum of both shares), and ``QUANTILE`` where a language has no such label. Null and empty texts have no perplexity and
are kept, as is everything if there is no trusted text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sievelog.session import ship_package, written

ORDER = 5
#: Bits of a code. Characters from ``PLAIN`` on take two codes, those from ``FAR`` on three, made of the other 1023.
BITS, PLAIN, FAR = 12, 3072, 1 << 18
LOW, HIGH, ESCAPE = PLAIN + 1, PLAIN + 513, PLAIN + 1019
QUANTILES = (0.9, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999)
QUANTILE = 0.99
BROADCAST_ROWS = 4_000_000
SMALL_LABELS = 2_000_000
NO_LANGUAGE = "und"


def codes(text: str) -> np.ndarray:
    """Character codes from 1 on, white space runs as one space; no two characters share theirs."""
    points = np.frombuffer(" ".join(text.split()).encode("utf-32-le"), np.uint32).astype(np.int64)
    wide, far = points >= PLAIN, points >= FAR
    if not wide.any():
        return points
    size = 1 + wide + far
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int64)
    out[at[~wide]] = points[~wide]
    rest, begin = points[wide & ~far] - PLAIN, at[wide & ~far]
    out[begin], out[begin + 1] = HIGH + rest // 512, LOW + rest % 512
    rest, begin = points[far] - FAR, at[far]
    out[begin], out[begin + 1], out[begin + 2] = ESCAPE + (rest >> 18), LOW + (rest >> 9 & 511), LOW + (rest & 511)
    return out


def runs(c: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The run of ``order`` characters that ends at each character; zeros stand before the text."""
    padded = np.concatenate([np.zeros(order - 1, np.int64), c])
    out = np.zeros(len(c), np.int64)
    for k in range(order):
        out = (out << BITS) | padded[k : k + len(c)]
    return out


def count_runs(texts: DataFrame) -> DataFrame:
    """(lang, g, c): how often each run of the highest order occurs; summed within batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by_lang.setdefault(lang, []).append(runs(codes(text.as_py())))
            for lang, found in by_lang.items():
                g, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(c.astype(np.int64))], ["lang", "g", "c"])

    counted = texts.select("lang", "text").mapInArrow(run, "lang string, g long, c long")
    return counted.groupBy("lang", "g").agg(F.sum("c").alias("c"))


def _suffix(order: int) -> Column:
    return F.col("g").bitwiseAND(F.lit((1 << BITS * (order - 1)) - 1))


def _context() -> Column:
    return F.shiftright("g", BITS)


def _discount(counts: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Discounts of counts of one, two and more, per language (a few numbers each)."""
    numbers = counts.groupBy("lang").agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    out = {}
    for r in numbers.collect():
        n = [max(1, r[f"n{k}"] or 0) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        out[r["lang"]] = tuple(min(0.95 * k, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) for k in (1, 2, 3))
    return out


def build(texts: DataFrame, order: int = ORDER) -> tuple[list[DataFrame], list[DataFrame]]:
    """Tables of orders 1 to ``order``: (lang, g, p) of the runs seen and (lang, ctx, gamma) of the contexts seen."""
    counts = {order: written(count_runs(texts), "runs")}
    for k in range(order - 1, 0, -1):
        # in how many ways a run is continued to the left
        lower = counts[k + 1].groupBy("lang", _suffix(k + 1).alias("g")).agg(F.count(F.lit(1)).alias("c"))
        counts[k] = written(lower, "runs")
    seen, backed = [], []
    below = None
    for k in range(1, order + 1):
        found = _discount(counts[k])
        if not found:
            return [], []
        d = F.create_map(*[F.lit(x) for lang, three in found.items() for x in (lang, F.array(*map(F.lit, three)))])
        rows = counts[k].withColumn("ctx", _context()).withColumn("d", d[F.col("lang")][F.least(F.col("c"), F.lit(3)).cast("int") - 1])
        contexts = rows.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("freed"))
        contexts = contexts.select("lang", "ctx", "total", (F.col("freed") / F.col("total")).alias("gamma"))
        rows = rows.join(contexts, ["lang", "ctx"])
        if k == 1:
            rows = rows.withColumn("q", F.lit(1.0 / (1 << BITS)))
        else:
            rows = rows.withColumn("suffix", _suffix(k)).join(below.select("lang", F.col("g").alias("suffix"), F.col("p").alias("q")), ["lang", "suffix"])
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("gamma") * F.col("q")
        below = written(rows.select("lang", "g", p.alias("p")), "model")
        seen.append(below)
        backed.append(written(contexts.select("lang", "ctx", "gamma"), "model"))
    return seen, backed


class Local:
    """The model as sorted arrays, one set per language."""

    def __init__(self, seen: list[pa.Table], backed: list[pa.Table]):
        self.langs = sorted(set(seen[0]["lang"].to_pylist()))
        self.tables = {
            lang: [(*self._sorted(s, lang, "g", "p"), *self._sorted(b, lang, "ctx", "gamma")) for s, b in zip(seen, backed)] for lang in self.langs
        }

    @staticmethod
    def _sorted(table: pa.Table, lang: str, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        mine = table.filter(pa.compute.equal(table["lang"], lang))
        keys, values = mine[key].to_numpy(), np.log(mine[value].to_numpy())
        order = np.argsort(keys)
        return keys[order], values[order].astype(np.float32)

    def log_probability(self, g: np.ndarray, lang: str) -> np.ndarray:
        """Log probability of each run's last character after the others, backing off where a run is new."""
        out = np.zeros(len(g), np.float32)
        live = np.arange(len(g))
        for k in range(len(self.tables[lang]), 0, -1):
            keys, values, contexts, gammas = self.tables[lang][k - 1]
            mine = g[live] & ((1 << BITS * k) - 1)
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            hit = keys[at] == mine
            out[live[hit]] += values[at[hit]]
            live, mine = live[~hit], mine[~hit] >> BITS
            if not len(live):
                return out
            at = np.minimum(np.searchsorted(contexts, mine), len(contexts) - 1)
            met = contexts[at] == mine
            out[live[met]] += gammas[at[met]]
        out[live] += np.float32(-np.log(1 << BITS))
        return out


def _scored_here(rows: DataFrame, seen: list[DataFrame], backed: list[DataFrame]) -> DataFrame:
    model = rows.sparkSession.sparkContext.broadcast(Local([t.toArrow() for t in seen], [t.toArrow() for t in backed]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = model.value
        for batch in batches:
            totals, sizes, named = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                g = runs(codes(text.as_py() or ""))
                tried = [lang] if lang in local.tables else local.langs
                scores = [(float(local.log_probability(g, one).sum(dtype=np.float64)), one) for one in tried] if len(g) else []
                best = max(scores, default=(None, lang))
                totals.append(best[0])
                named.append(best[1])
                sizes.append(len(g))
            yield pa.record_batch(
                [batch.column("row"), pa.array(named, pa.string()), pa.array(totals, pa.float64()), pa.array(sizes, pa.int64())],
                ["row", "model", "total", "n_units"],
            )

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, model string, total double, n_units long")


def _scored_by_joins(rows: DataFrame, seen: list[DataFrame], backed: list[DataFrame]) -> DataFrame:
    """The same by joining each document's counted runs with the sharded tables, one order after the other."""
    langs = [r["lang"] for r in seen[0].select("lang").distinct().collect()]
    keyed = rows.withColumn("id", F.struct(F.col("row.doc_id").alias("d"), F.xxhash64("text", "lang").alias("h")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                g, n = np.unique(runs(codes(text.as_py() or "")), return_counts=True)
                for one in [lang] if lang in langs else langs:
                    at = pa.array(np.full(len(g), i), pa.int32())
                    yield pa.record_batch([batch.column(0).take(at), pa.array([one] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], ["id", "lang", "g", "n"])

    kind = keyed.schema["id"].dataType.simpleString()
    left = keyed.select("id", "lang", "text").distinct().mapInArrow(run, f"id {kind}, lang string, g long, n long")
    parts = []
    for k in range(len(seen), 0, -1):
        left = left.withColumn("g", F.col("g").bitwiseAND(F.lit((1 << BITS * k) - 1)))
        joined = written(left.join(seen[k - 1], ["lang", "g"], "left"), "joined")
        parts.append(joined.where("p is not null").select("id", "lang", (F.col("n") * F.log("p")).alias("part")))
        left = joined.where("p is null").select("id", "lang", "g", "n", _context().alias("ctx")).join(backed[k - 1], ["lang", "ctx"], "left")
        parts.append(left.where("gamma is not null").select("id", "lang", (F.col("n") * F.log("gamma")).alias("part")))
        left = left.select("id", "lang", "g", "n")
    parts.append(left.select("id", "lang", (F.col("n") * F.lit(-float(np.log(1 << BITS)))).alias("part")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    totals = out.groupBy("id", "lang").agg(F.sum("part").alias("total")).groupBy("id").agg(F.max(F.struct("total", "lang")).alias("b"))
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    more = [F.char_length(F.regexp_replace(plain, rf"[^\x{{{first:x}}}-\x{{10FFFF}}]+", "")) for first in (PLAIN, FAR)]
    sizes = keyed.withColumn("n_units", (F.char_length(plain) + more[0] + more[1]).cast("long"))
    joined = sizes.join(totals, "id", "left")
    return joined.select("row", F.coalesce("b.lang", "lang").alias("model"), F.col("b.total").alias("total"), "n_units")


def perplexities(documents: DataFrame, seen: list[DataFrame], backed: list[DataFrame], broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, model, perplexity, n_units). A model of at most ``broadcast_rows`` rows is sent to the texts."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(row).select("row", F.coalesce("row.lang", F.lit(NO_LANGUAGE)).alias("lang"), F.col("row.text").alias("text"))
    if not seen:
        none = rows.select("row", F.col("lang").alias("model"), F.lit(None).cast("double").alias("perplexity"))
        return none.withColumn("n_units", F.lit(0).cast("long"))
    size = sum(t.count() for t in seen + backed)
    scored = (_scored_here if size <= broadcast_rows else _scored_by_joins)(rows, seen, backed)
    return scored.select("row", "model", F.exp(-F.col("total") / F.col("n_units")).alias("perplexity"), "n_units")


def thresholds(left_out: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(model, threshold) from (model, perplexity, quality) of labelled documents that did not train the model."""
    left_out = written(left_out, "judged")
    tried = [*QUANTILES, quantile]
    good = F.when(F.col("quality") == 1, F.col("perplexity"))
    limits = left_out.groupBy("model").agg(F.percentile_approx(good, tried, 10_000).alias("limits")).where("limits is not null")
    rows = left_out.join(F.broadcast(limits), "model")  # one row per language of trusted text
    kept = [F.avg((good <= F.col("limits")[k]).cast("int")) for k in range(len(QUANTILES))]
    bad = F.when(F.col("quality") == 0, F.col("perplexity"))
    caught = [F.avg((bad > F.col("limits")[k]).cast("int")) for k in range(len(QUANTILES))]
    # of equal sums the highest quantile counts
    sums = [F.struct(F.round(a + b, 9).alias("sum"), F.lit(k).alias("k")) for k, (a, b) in enumerate(zip(kept, caught))]
    best = rows.groupBy("model").agg(F.greatest(*sums).alias("best"), F.first("limits").alias("limits"), F.count(bad).alias("n_bad"))
    chosen = F.when(F.col("n_bad") > 0, F.col("limits")[F.col("best.k")]).otherwise(F.col("limits")[len(QUANTILES)])
    return best.select("model", chosen.alias("threshold"))


def classify(documents: DataFrame, labels: DataFrame, quantile: float = QUANTILE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, perplexity, threshold, keep) of every document.

    Half of the documents of quality 1, by a hash of the id, train the model; the other half and the documents of
    quality 0 set the thresholds. ``quantile`` holds for languages without a document of quality 0.
    """
    ship_package(documents.sparkSession)
    judged = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    judged = F.broadcast(judged) if judged.count() <= SMALL_LABELS else judged
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    known = documents.select("doc_id", "text", "lang").join(judged, "doc_id")
    trusted = known.where((F.col("quality") == 1) & (half == 0) & (F.length("text") > 0))
    seen, backed = build(trusted.select("text", F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang")))
    left_out = known.where((F.col("quality") == 0) | (half == 1))
    left_out = perplexities(left_out, seen, backed, broadcast_rows).where("perplexity is not null")
    limits = written(thresholds(left_out.select("model", "perplexity", "row.quality"), quantile), "limits")
    scored = perplexities(documents, seen, backed, broadcast_rows)
    out = scored.join(F.broadcast(limits), "model", "left")  # one row per language of trusted text
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("row", "perplexity", "threshold", keep.alias("keep"), "n_units")
