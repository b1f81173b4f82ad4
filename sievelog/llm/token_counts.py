"""Token counts through a cache of digests.

The cache is a table of (content digest, tokenizer digest, tokens) in a folder. Counting a batch of documents

1. takes the digest of each normalised content, a narrow table of ids and digests;
2. joins the distinct digests with the stored counts of this version of the tokenizer; what is not found is a miss;
3. moves the texts of misses alone to their digest, keeps one of each, encodes it, and appends the counts;
4. looks the counts of all rows up by digest, the rows of a frequent digest spread over many tasks.

A text that occurs a million times is combined before it is shuffled and encoded once; a second run over the same texts
encodes nothing. The tokenizer's digest covers its file, the library's name and version and the way special strings are
handled, so a changed file never meets old counts. A batch is appended by one Parquet write to a folder of its own. A
failed job leaves nothing or right counts, which the next one finds. Two jobs that append the same digest at once store
it twice, and it is read once.

Normalised content is the text as the tokenizer sees it: null is the empty text, and bytes that are no UTF-8 become
replacement characters. Equal contents have equal counts, so repeated rows and ties agree; rows without an id are counted
like others. Texts of any length are encoded whole; empty tables give empty tables and append nothing. Columns to keep
are named by the caller, whatever the names of the others.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from sievelog.operators.lookup import spread_lookup
from sievelog.session import scratch_path, ship_package, written

LIMIT = 1024
STRETCHES = 1_000_000
LONG_STRETCH = 64
WORDS_AT_ONCE = 1000
BATCH_CHARS = 1 << 20
#: Misses up to this number, of 32 bytes each, are sent to the documents.
SMALL = 1 << 16
STORED = "digest binary, n_tokens long"

#: Characters about whose being white space patterns differ, and white space other than blanks and line breaks.
_ODD = re.compile("[^\\S \n]|[\x1c-\x1f\x85\u180e\u200b-\u200f\u2028-\u202f\u2060\ufeff]")
#: Stretches that no piece of a byte-level tokenizer reaches across: a piece never goes on from a character to a blank or
#: line break after it, nor from a letter to the punctuation after it.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_STRETCHES = re.compile(f"[ \n]*[{_LETTERS}]+(?=[.,;:!?])|[ \n]*[^ \n]+|[ \n]+")
_WORD = re.compile(f" [{_LETTERS}]+")


@functools.lru_cache(maxsize=2)
def counter(path: str):
    """A function from texts to their numbers of tokens, one per worker process and file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(model.encode(t, num_threads=1)) for t in texts]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path) as f:
        config = json.load(f)
    if _splits_at_spaces(config):
        return StretchCounter(tokenizer)
    return lambda texts: [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def _splits_at_spaces(config: dict) -> bool:
    """Byte-level pieces by the usual pattern over the text as it is, so that cutting at single spaces changes no piece."""
    split = config.get("pre_tokenizer") or {}
    added = config.get("added_tokens") or []
    return (
        config.get("normalizer") is None
        and (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False)
        and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or re.search(r"\s", a["content"]) for a in added)
    )


class StretchCounter:
    """Sums the library's counts of the stretches of texts, remembering those of short ones, at most about ``STRETCHES``.

    Unknown single words are encoded together, many at a time, and their tokens counted by the piece they come from.
    """

    def __init__(self, tokenizer):
        self._encode = functools.partial(tokenizer.encode, add_special_tokens=False)
        self._known: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [[t] if _ODD.search(t) else _STRETCHES.findall(t) for t in texts]
        if len(self._known) >= STRETCHES:
            self._known = {}
        known = self._known
        unknown = {x for stretches in cut for x in stretches if x not in known}
        words = [x for x in unknown if _WORD.fullmatch(x)]
        for i in range(0, len(words), WORDS_AT_ONCE):
            part = words[i : i + WORDS_AT_ONCE]
            pieces = np.array(self._encode("".join(part)).word_ids, np.int64)
            known.update(zip(part, np.bincount(pieces, minlength=len(part)).tolist()))
        others = {x: len(self._encode(x).ids) for x in unknown if x not in known}
        known.update((x, n) for x, n in others.items() if len(x) <= LONG_STRETCH)
        whole = {x: n for x, n in others.items() if len(x) > LONG_STRETCH}
        if not whole:
            return [sum(map(known.__getitem__, stretches)) for stretches in cut]
        return [sum(known[x] if x in known else whole[x] for x in stretches) for stretches in cut]


def tokenizer_digest(path: str) -> str:
    """Names this version of a tokenizer: library and version, settings, and the file's content."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        content = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(f"{library.__name__} {library.__version__} default specials {content}".encode()).hexdigest()


def normalised(text: Column) -> Column:
    """The content that is counted."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.is_valid_utf8(text), text).otherwise(F.make_valid_utf8(text))


class TokenCache:
    """Stored counts of one version of a tokenizer, below ``folder``; a folder may serve many versions."""

    def __init__(self, spark: SparkSession, folder: str, tokenizer: str):
        self.spark, self.tokenizer = spark, tokenizer
        self.path = f"{folder.rstrip('/')}/tokenizer={tokenizer_digest(tokenizer)}"
        try:
            self._read()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            self._store(spark.createDataFrame([], STORED))

    def _read(self) -> DataFrame:
        return self.spark.read.schema(STORED).option("recursiveFileLookup", True).parquet(self.path)

    def _store(self, counts: DataFrame) -> None:
        # a folder for each batch, so that jobs which append at the same time do not share temporary files
        counts.write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def stored(self) -> DataFrame:
        """(digest, n_tokens), each digest once."""
        return self._read().groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, contents: DataFrame) -> None:
        """Encode the texts of (digest, content) and store their counts."""
        ship_package(self.spark)
        path = self.tokenizer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = counter(path)
            for batch in batches:
                n: list[int] = []
                held: list[str] = []
                size = 0
                for content in batch.column("content"):
                    held.append(content.as_py())
                    size += len(held[-1])
                    if size >= BATCH_CHARS:
                        n += count(held)
                        held, size = [], 0
                n += count(held)
                yield pa.record_batch([batch.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

        schema = T.StructType().add("digest", "binary").add("n_tokens", "long")
        self._store(contents.select("digest", "content").mapInArrow(run, schema))


def count_tokens(
    documents: DataFrame, cache: TokenCache, keep: Sequence[str] = ("doc_id",), text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """Per document: the columns ``keep``, n_bytes, n_tokens, over_limit. Misses are appended to the cache."""
    content = normalised(F.col(text))
    digest = F.unhex(F.sha2(content.cast("binary"), 256)).alias("digest")
    number = F.monotonically_increasing_id().alias("number")
    rows = documents.select(F.struct(*keep).alias("row"), digest, F.octet_length(content).cast("long").alias("n_bytes"), number)
    rows = written(rows, "digests")
    misses = written(rows.select("digest").distinct().join(cache.stored(), "digest", "left_anti"), "misses")
    n = misses.count()
    if n:
        texts = documents.select(digest, content.alias("content"))
        if n <= SMALL:  # hits leave before anything moves
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        # one text of each digest per task, then one of all
        once = texts.groupBy("digest").agg(F.first("content").alias("content"))
        cache.append(once if n <= SMALL else once.join(misses, "digest", "left_semi"))
    counted = spread_lookup(rows, ["digest"], cache.stored(), ["number"])
    return counted.select("row.*", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def own_cache(spark: SparkSession, tokenizer: str) -> TokenCache:
    """A new cache in the shared folder."""
    return TokenCache(spark, scratch_path(spark, "token-counts"), tokenizer)
