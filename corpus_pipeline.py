"""Five stages from raw documents to packed token sequences, each written as Parquet and read again.

1. ``language_id`` drops documents without a recognisable language: no letter, no text, or a best language below
   ``MIN_LANGUAGE``.
2. ``line_dedup`` takes repeated lines out of all documents but the one with the highest id, and drops the documents that
   this leaves without a word: their lines all stand elsewhere.
3. ``near_duplicates`` keeps the document with the lowest id of every group linked by a similarity of
   ``NEAR_PERCENT`` over shingles of ``NEAR_WIDTH`` words. Texts without words have no group and stay.
4. ``decontaminate`` drops documents that hold a span of a benchmark item.
5. ``pack`` cuts what is left into token pieces and packs them.

All but the last return the columns of ``documents``, in their order; others that the table has, whatever their names,
travel along. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sievelog.llm import decontaminate, jaccard, langid, lines, packing
from sievelog.llm.queries import tokenizer
from sievelog.session import written

MIN_LANGUAGE = 0.3
#: Words of a shingle and least similarity of near copies; the op7 query has others of its own.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
SMALL_IDS = 1 << 20
#: Documents handed to Python at a time. They are whole texts, so the default of 10,000 takes more memory than it saves time.
BATCH_ROWS = 1000
WORD = "[^\\x20\\x09-\\x0D]"


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose id is not listed; a short list is sent to the documents, a long one meets them by id."""
    gone = written(gone.select("doc_id").where("doc_id is not null").distinct(), "gone")
    return docs.join(F.broadcast(gone) if gone.count() <= SMALL_IDS else gone, "doc_id", "left_anti").select(*docs.columns)


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    found = langid.identify(docs)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    cleaned = lines.dedup_lines(docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept"))
    changed = {"text": text, "n_chars": F.char_length(text).cast("long")}
    emptied = (F.col("n_dropped") > 0) & ~F.col("kept").rlike(WORD)
    return cleaned.where(~emptied).select(*[changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return _without(docs, jaccard.join_components(docs, percent=NEAR_PERCENT, width=NEAR_WIDTH).where("doc_id <> component_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_hits(docs, benchmark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.pack(docs, tokenizer())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("pack", pack),
]

#: The first stage is a trained network, which SQL cannot express; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
