"""One registered query per operator of this package, over whole tables, and their SQL where it can be given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelog.llm import (
    decontaminate,
    fim,
    fingerprints,
    html,
    jaccard,
    langid,
    lines,
    packing,
    periods,
    quality,
    token_counts,
    tokens,
    toxicity,
)
from sievelog.session import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The public vocabulary the token queries are fixed to."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 4 == 2
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return scored.select(
        "row.doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", predicted.alias("predicted"), "n_hits"
    )


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("row.doc_id", "perplexity", "threshold", "keep", "n_units")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write(_table(spark, sf_dir, "documents"), path, tokenizer())
    return tokens.read(spark, path)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(_table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = html.extract(_table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents")).select("row.doc_id", "held_out", "lang_pred", "score")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = periods.periodic_runs(docs.withColumn("text", periods.repeat_tail(F.col("text"), h)))
    best = periods.longest_run(F.col("runs"))
    listed = F.transform("runs", lambda r: F.concat_ws(",", *[r[x].cast("string") for x in ("start", "length", "period")]))
    lines_ = F.array_join(F.transform(listed, lambda x: F.concat(x, F.lit("\n"))), "")
    found = found.select("row.doc_id", "runs", best.alias("best"), F.sha2(lines_, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", exponent, "runs_sha256", "collapsed_sha256")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = token_counts.own_cache(spark, tokenizer("byte_bpe_50k.json"))
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), cache)


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_pattern_packing": op3_pattern_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality": op5_quality,
    "op6_token_files": op6_token_files,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_html_text": op8_html_text,
    "op9_language": op9_language,
    "op10_decontamination": op10_decontamination,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_counts": op13_token_counts,
}

_OP10 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
   'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_starts AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i
  FROM items WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM item_starts),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n),
hits AS (SELECT DISTINCT doc_id, i, d.n, item_id FROM
  (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM doc_starts) d JOIN item_windows USING (win)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM
  (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
met AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
 CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN spots USING (doc_id) LEFT JOIN met USING (doc_id)
"""


_KEY = r"translate(regexp_replace(regexp_replace({x}, '\A[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+\z', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP4 = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM split),
keyed AS (SELECT doc_id, i, line, {_KEY.format(x="line")} AS k FROM lines),
held AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM keyed LEFT JOIN held USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_OP11 = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
draws AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2,
 CAST('0x' || substr(x, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM texts),
cuts AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
 WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM draws),
made AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
  ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM made
"""

ORACLES = {"op4_line_dedup": _OP4, "op10_decontamination": _OP10, "op11_fill_in_middle": _OP11}
