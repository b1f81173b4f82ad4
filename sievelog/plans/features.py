"""Registered queries: row features, phrase matches, vectors, neighbourhoods, term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievelog.functions.patterns import (
    ANOMALOUS_PHRASES,
    ANOMALY_KEYWORDS,
    ATTACK_SIGNATURES,
    PATTERNS,
    SECURITY_KEYWORDS,
)
from sievelog.functions.text import ALNUM, DIGITS, LETTERS, UPPER, WS
from sievelog.operators import context, predicates, semantic, similar, tfidf
from sievelog.operators import features as ft
from sievelog.plans.views import log_entries, table
from sievelog.plans.views_sql import ENTRIES

# a fixed stop list keeps the Spark and the SQL side on the same words
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "it", "for", "on", "with", "as", "at", "by", "that", "this")
SUSPICIOUS = ("10.0.1.41", "10.0.2.42", "10.0.3.43", "192.168.1.100", "10.0.0.50")


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))


def _texts(spark, sf_dir) -> DataFrame:
    """Every long text of the given tables: documents, raw pages and conversation turns."""
    docs = table(spark, sf_dir, "documents").select(
        F.lit("d").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("message")
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("p").alias("kind"), F.col("page_id").cast("string").alias("id"), F.col("html").alias("message")
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("c").alias("kind"), F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("message")
    )
    return docs.unionByName(pages).unionByName(turns)


TEXTS = """texts AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text AS message FROM documents
 UNION ALL SELECT 'p', CAST(page_id AS VARCHAR), html FROM pages
 UNION ALL SELECT 'c', CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), text FROM conversations)"""

_RATIOS = ("digit_ratio", "alpha_ratio", "upper_ratio", "special_char_ratio")
_BASIC = (
    "hour", "day_of_week", "is_weekend", "message_length", "word_count", "char_count", "line_length",
    "log_level_info", "log_level_warn", "log_level_error", "log_level_debug", *_RATIOS,
)


def basic_features(spark, sf_dir):
    entries = log_entries(spark, sf_dir).withColumn("raw_log", F.concat_ws(" ", "file", "message"))
    return _round(ft.basic_features(entries).select("line_no", *_BASIC), *_RATIOS)


def char_ratios(spark, sf_dir):
    return _round(ft.char_ratios(_texts(spark, sf_dir)).select("kind", "id", *_RATIOS), *_RATIOS)


def text_lengths(spark, sf_dir):
    return ft.length_features(_texts(spark, sf_dir), raw=None).select(
        "kind", "id", "message_length", "word_count"
    )


def level_flags(spark, sf_dir):
    names = [c for c in _BASIC if c.startswith("log_level")]
    return ft.level_flags(log_entries(spark, sf_dir)).select("line_no", *names)


def temporal_features(spark, sf_dir):
    return ft.temporal_features(log_entries(spark, sf_dir)).select("line_no", "hour", "day_of_week", "is_weekend")


def _entropy(*columns):
    def query(spark, sf_dir):
        out = ft.entropy_features(_texts(spark, sf_dir)).select("kind", "id", *columns)
        return _round(out, *[c for c in columns if not c.startswith("unique")])

    return query


def pattern_counts(spark, sf_dir):
    out = ft.pattern_counts(_texts(spark, sf_dir))
    return out.select("kind", "id", *[f"{p}_{n}" for n in PATTERNS for p in ("count", "has")])


def security_keywords(spark, sf_dir):
    names = [c for k in SECURITY_KEYWORDS for c in (f"security_{k}_count", f"has_security_{k}")]
    return ft.security_keywords(_texts(spark, sf_dir)).select("kind", "id", *names)


def extra_patterns(spark, sf_dir):
    names = ("has_numbers", "has_uppercase", "has_brackets", "has_quotes", "consecutive_spaces")
    return ft.extra_patterns(_texts(spark, sf_dir)).select("kind", "id", *names)


def repeated_chars(spark, sf_dir):
    return ft.extra_patterns(_texts(spark, sf_dir)).select("kind", "id", "repeated_chars")


def keyword_label(spark, sf_dir):
    return _texts(spark, sf_dir).select(
        "kind", "id", predicates.keyword_label(F.col("message")).alias("is_anomaly")
    )


def signature_match(spark, sf_dir):
    entries = log_entries(spark, sf_dir).select(F.lit("e").alias("kind"), F.col("line_no").cast("string").alias("id"), "message")
    matched = predicates.signature_matches(entries.unionByName(_texts(spark, sf_dir)))
    return matched.select(
        "kind",
        "id",
        F.array_join("signatures", ",").alias("signatures"),
        F.array_join("anomalous_phrases", ",").alias("anomalous_phrases"),
    )


def suspicious_ip(spark, sf_dir):
    found = predicates.from_suspicious_ip(log_entries(spark, sf_dir), suspicious=SUSPICIOUS)
    return found.select("line_no", "message")


def suspicious_ip_semi(spark, sf_dir):
    """Entries naming an address that also occurs in the documents."""
    docs = _docs(spark, sf_dir)
    listed = docs.where(F.col("message").contains(".")).select(
        F.explode(predicates.ip_addresses(F.col("message"))).alias("ip")
    )
    entries = log_entries(spark, sf_dir)
    mentioned = entries.where("is_anomaly").select(
        F.explode(predicates.ip_addresses(F.col("message"))).alias("ip")
    )
    addresses = listed.unionByName(mentioned).groupBy("ip").agg(F.count(F.lit(1)).alias("n"))
    found = predicates.from_suspicious_ip(entries, suspicious=addresses.where("n >= 3"), key="line_no")
    return found.select("line_no", "message")


def embedding_stats(spark, sf_dir):
    out = semantic.embedding_stats(table(spark, sf_dir, "embeddings"))
    names = [f"embedding_{s}" for s in ("norm", "mean", "std", "max", "min")]
    return _round(out.select("vec_id", *names), *names)


def cosine_pairs(spark, sf_dir):
    """Each vector against the next one."""
    vectors = table(spark, sf_dir, "embeddings")
    pairs = vectors.select(F.col("vec_id").alias("left_id"), (F.col("vec_id") + 1).alias("right_id"))
    out = semantic.pair_similarity(pairs, vectors, "left_id", "right_id", "vec_id")
    return _round(out.select("left_id", "right_id", "similarity"), "similarity")


def message_memo(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("text").alias("message"))
    return semantic.message_memo(turns)


def encode_messages(spark, sf_dir):
    """Vectors of all conversation turns, each distinct text encoded once, with their norms."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("message"))
    encoded = semantic.encode_messages(turns, ["conv_id", "turn"])
    stats = semantic.embedding_stats(encoded)
    return _round(stats.select("conv_id", "turn", "embedding_norm"), "embedding_norm")


def message_similarity(spark, sf_dir):
    """Similarity of each conversation turn to the turn after it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("message"))
    vectors = semantic.encode_messages(turns, ["conv_id", "turn"]).withColumn("at", F.struct("conv_id", "turn"))
    pairs = turns.select(
        F.struct("conv_id", "turn").alias("a"),
        F.struct("conv_id", (F.col("turn") + 1).alias("turn")).alias("b"),
    )
    out = semantic.pair_similarity(pairs, vectors, "a", "b", "at")
    return _round(out.select("a.conv_id", "a.turn", "similarity"), "similarity")


def _asked_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors, vectors.where("vec_id % 100 = 0")


def top_similar(spark, sf_dir):
    """The ten vectors most similar to each one whose id is divisible by 100, exactly."""
    vectors, asked = _asked_vectors(spark, sf_dir)
    return similar.similar(vectors, asked, "vec_id", k=10, exact=True)


def top_similar_probed(spark, sf_dir):
    """The same from the nearest lists only; recall is measured in the tests."""
    vectors, asked = _asked_vectors(spark, sf_dir)
    return similar.similar(vectors, asked, "vec_id", k=10)


def top_similar_messages(spark, sf_dir):
    """The three messages most similar, by their word vectors, to each distinct one whose digest begins below 03."""
    memo = semantic.message_memo(table(spark, sf_dir, "conversations").select(F.col("text").alias("message")))
    encoded = memo.select("message_md5", semantic.hashed_vector(F.col("message")).alias("embedding"))
    asked = encoded.where(F.col("message_md5") < "03")
    return similar.similar(encoded, asked, "message_md5", k=3, exact=True)


def _round_context(df: DataFrame) -> DataFrame:
    # a mean of ten gaps has seven decimals, all of them exact
    names = [c for c in context.CONTEXT_COLUMNS if c in df.columns and not c.startswith("unique")]
    return df.withColumns({c: F.round(c, 9 if c == "avg_time_delta" else 6) for c in names})


def _context(*columns):
    def query(spark, sf_dir):
        out = context.context_features(log_entries(spark, sf_dir), columns=columns)
        return _round_context(out.select("line_no", *columns))

    return query


def conversation_context(spark, sf_dir):
    """Similarity of conversation turns to the turns around them."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("role").alias("source"), F.col("text").alias("message")
    )
    names = ("avg_similarity_in_window", "max_similarity_in_window")
    out = context.context_features(turns, ["conv_id"], "turn", names)
    return _round(out.select("conv_id", "turn", *names), *names)


_ALL_ROUNDED = (*_RATIOS, "char_entropy", "word_entropy", "avg_word_length")


def all_features(spark, sf_dir):
    """Every feature of every entry, with its index, time and message."""
    entries = log_entries(spark, sf_dir).withColumn("raw_log", F.concat_ws(" ", "file", "message"))
    indexed = context.entry_index(entries)
    out = ft.row_features(context.context_features(indexed))
    patterns = [f"{p}_{n}" for n in PATTERNS for p in ("count", "has")]
    security = [c for k in SECURITY_KEYWORDS for c in (f"security_{k}_count", f"has_security_{k}")]
    extra = ["has_numbers", "has_uppercase", "has_brackets", "has_quotes", "repeated_chars", "consecutive_spaces"]
    entropy = ["char_entropy", "word_entropy", "unique_chars", "unique_words", "avg_word_length"]
    columns = [*_BASIC, *entropy, *patterns, *security, *extra, *context.CONTEXT_COLUMNS]
    return _round(
        _round_context(out).select(
            "file",
            "entry_index",
            F.date_format("ts_wall", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
            F.col("message").alias("raw_message"),
            *columns,
        ),
        *_ALL_ROUNDED,
    )


def entry_index(spark, sf_dir):
    return context.entry_index(log_entries(spark, sf_dir)).select("file", "line_no", "entry_index")


def chunk_counts(spark, sf_dir):
    return context.chunk_counts(log_entries(spark, sf_dir), 100)


def tfidf_vocabulary(spark, sf_dir):
    model = tfidf.fit_tfidf(_docs(spark, sf_dir), stop_words=STOP_WORDS)
    return _round(model.vocabulary, "idf")


def tfidf_weights(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    model = tfidf.fit_tfidf(docs, stop_words=STOP_WORDS)
    return _round(tfidf.tfidf_weights(docs, model, "doc_id"), "tfidf")


def rare_words(spark, sf_dir):
    return tfidf.rare_words(_docs(spark, sf_dir), "doc_id")


QUERIES = {
    "basic_features": basic_features,
    "level_flags": level_flags,
    "temporal_features": temporal_features,
    "char_ratios": char_ratios,
    "text_lengths": text_lengths,
    "char_entropy": _entropy("char_entropy"),
    "word_entropy": _entropy("word_entropy"),
    "unique_tokens": _entropy("unique_chars", "unique_words"),
    "avg_word_length": _entropy("avg_word_length"),
    "pattern_counts": pattern_counts,
    "security_keywords": security_keywords,
    "extra_patterns": extra_patterns,
    "repeated_chars": repeated_chars,
    "keyword_label": keyword_label,
    "signature_match": signature_match,
    "suspicious_ip": suspicious_ip,
    "suspicious_ip_semi": suspicious_ip_semi,
    "embedding_stats": embedding_stats,
    "cosine_pairs": cosine_pairs,
    "message_memo": message_memo,
    "encode_messages": encode_messages,
    "message_similarity": message_similarity,
    "top_similar": top_similar,
    "top_similar_probed": top_similar_probed,
    "top_similar_messages": top_similar_messages,
    "time_delta_window": _context("avg_time_delta", "std_time_delta", "max_time_delta"),
    "level_ratio_window": _context("error_ratio_in_window", "warn_ratio_in_window"),
    "unique_sources_window": _context("unique_sources_in_window"),
    "jaccard_window": _context("avg_similarity_in_window", "max_similarity_in_window"),
    "conversation_context": conversation_context,
    "all_features": all_features,
    "entry_index": entry_index,
    "chunk_counts": chunk_counts,
    "tfidf_vocabulary": tfidf_vocabulary,
    "tfidf_weights": tfidf_weights,
    "rare_words": rare_words,
}


# ---- SQL counterparts ------------------------------------------------------------------------------------


def _share(cls: str, negate: bool = False) -> str:
    keep = f"[{cls}]" if negate else f"[^{cls}]"
    return (
        f"round(CASE WHEN length(message) > 0 THEN length(regexp_replace(message, '{keep}', '', 'g')) * 1.0 "
        "/ length(message) ELSE 0.0 END, 6)"
    )


_RATIO_SQL = (
    f"{_share(DIGITS)} AS digit_ratio, {_share(LETTERS)} AS alpha_ratio, {_share(UPPER)} AS upper_ratio, "
    f"{_share(ALNUM + WS, True)} AS special_char_ratio"
)
_TIME_SQL = (
    "hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, isodow(ts) >= 6 AS is_weekend"
)
_LEVEL_SQL = (
    "CAST(level = 'INFO' AS INT) AS log_level_info, CAST(level IN ('WARN', 'WARNING') AS INT) AS log_level_warn, "
    "CAST(level IN ('ERROR', 'CRITICAL', 'FATAL') AS INT) AS log_level_error, CAST(level = 'DEBUG' AS INT) AS log_level_debug"
)
_WORDS = f"len(regexp_extract_all(message, '[^{WS}]+'))"
_BASIC_SQL = (
    f"{_TIME_SQL}, length(message) AS message_length, {_WORDS} AS word_count, length(message) AS char_count, "
    f"length(file || ' ' || message) AS line_length, {_LEVEL_SQL}, {_RATIO_SQL}"
)


def _entropy_cte(source: str, key: str) -> str:
    """Per-key character and word statistics by unnesting and grouping."""
    return f"""ch AS (SELECT {key}, c, count(*) AS n FROM (SELECT {key}, unnest(string_split(lower(message), '')) AS c
  FROM {source} WHERE message <> '') GROUP BY ALL),
chs AS (SELECT {key}, -sum(n * 1.0 / length(message) * log2(n * 1.0 / length(message))) AS char_entropy, count(*) AS unique_chars
  FROM ch JOIN {source} USING ({key}) GROUP BY {key}),
wd AS (SELECT {key}, w, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(message), '[^{WS}]+')) AS w
  FROM {source}) GROUP BY ALL),
tot AS (SELECT {key}, sum(n) AS total FROM wd GROUP BY {key}),
wds AS (SELECT {key}, -sum(n * 1.0 / total * log2(n * 1.0 / total)) AS word_entropy, count(*) AS unique_words,
  sum(n * length(w)) * 1.0 / sum(n) AS avg_word_length FROM wd JOIN tot USING ({key}) GROUP BY {key}),
ent AS (SELECT {key}, round(coalesce(char_entropy, 0), 6) AS char_entropy, round(coalesce(word_entropy, 0), 6) AS word_entropy,
  coalesce(unique_chars, 0) AS unique_chars, coalesce(unique_words, 0) AS unique_words,
  round(coalesce(avg_word_length, 0), 6) AS avg_word_length
  FROM {source} LEFT JOIN chs USING ({key}) LEFT JOIN wds USING ({key}))"""


def _entropy_sql(*columns: str) -> str:
    return f"WITH {TEXTS}, {_entropy_cte('texts', 'kind, id')} SELECT kind, id, {', '.join(columns)} FROM ent"


# fixed values: the patterns in the SQL engine's dialect
_SQL_PATTERNS = {
    "ip_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "url": r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+",
    "file_path": r'[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*|/(?:[^/\x00]+/)*[^/\x00]*',
    "hash": r"\b[a-fA-F0-9]{32,64}\b",
    "sql_keywords": r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|UNION|WHERE|FROM)\b",
    "script_tags": r"(?is)<script[^>]*>.*?</script>",
}


def _pattern_sql() -> str:
    cells = []
    for name, pattern in _SQL_PATTERNS.items():
        count = f"len(regexp_extract_all(message, '{pattern}'))"
        cells += [f"{count} AS count_{name}", f"CAST({count} > 0 AS INT) AS has_{name}"]
    return ", ".join(cells)


def _security_sql() -> str:
    cells = []
    for category, keywords in SECURITY_KEYWORDS.items():
        total = " + ".join(
            f"(length(lower(message)) - length(replace(lower(message), '{k}', ''))) // {len(k)}" for k in keywords
        )
        cells += [f"{total} AS security_{category}_count", f"CAST(({total}) > 0 AS INT) AS has_security_{category}"]
    return ", ".join(cells)


_EXTRA_SQL = (
    "CAST(regexp_matches(message, '\\p{Nd}') AS INT) AS has_numbers, CAST(regexp_matches(message, '[A-Z]') AS INT) AS has_uppercase, "
    "CAST(regexp_matches(message, '[\\[\\]{}()]') AS INT) AS has_brackets, CAST(regexp_matches(message, '[\"'']') AS INT) AS has_quotes, "
    "len(regexp_extract_all(message, ' {2,}')) AS consecutive_spaces"
)


def _repeats_cte(source: str, key: str) -> str:
    return f"""pos AS (SELECT {key}, unnest(string_split(message, '')) AS c, generate_subscripts(string_split(message, ''), 1) AS i
  FROM {source}),
isl AS (SELECT {key}, c, i - row_number() OVER (PARTITION BY {key}, c ORDER BY i) AS g FROM pos),
rep AS (SELECT {key}, count(*) AS repeated_chars FROM (SELECT {key}, c, g FROM isl WHERE c <> chr(10)
  GROUP BY ALL HAVING count(*) >= 3) GROUP BY {key})"""


def _phrases(phrases) -> str:
    cells = ", ".join(f"CASE WHEN contains(lower(message), '{p}') THEN '{p}' END" for p in phrases)
    return f"concat_ws(',', {cells})"


_ALL_TEXTS = TEXTS + ", every AS (SELECT 'e' AS kind, CAST(line_no AS VARCHAR) AS id, message FROM log_entries UNION ALL SELECT * FROM texts)"
_IPS = f"regexp_extract_all(message, '{_SQL_PATTERNS['ip_address']}')"

_FRAME = "(PARTITION BY file ORDER BY line_no ROWS BETWEEN {} AND 5 FOLLOWING)"
_TIME_WINDOW = f"""gaps AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY file ORDER BY line_no)) AS d FROM log_entries),
tw AS (SELECT line_no, round(avg(d) OVER w / 1e6, 9) AS avg_time_delta, round(stddev_pop(d) OVER w / 1e6, 6) AS std_time_delta,
 round(max(d) OVER w / 1e6, 6) AS max_time_delta FROM gaps WINDOW w AS {_FRAME.format('4 PRECEDING')})"""
_LEVEL_WINDOW = f"""lw AS (SELECT line_no, CASE WHEN count(*) OVER w > 1 THEN round(avg(CASE WHEN level = 'ERROR' THEN 1.0 ELSE 0.0 END) OVER w, 6) END AS error_ratio_in_window,
 CASE WHEN count(*) OVER w > 1 THEN round(avg(CASE WHEN level = 'WARN' THEN 1.0 ELSE 0.0 END) OVER w, 6) END AS warn_ratio_in_window,
 CASE WHEN count(*) OVER w > 1 THEN count(DISTINCT coalesce(source, chr(1))) OVER w END AS unique_sources_in_window
 FROM log_entries WINDOW w AS {_FRAME.format('5 PRECEDING')})"""


def _jaccard(source: str, group: str, order: str, entry: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS rn,
  list_distinct(regexp_extract_all(lower(message), '[^{WS}]+')) AS words FROM {source}),
sims AS (SELECT a.{group}, a.{order}, len(list_intersect(a.words, b.words)) * 1.0 / len(list_distinct(list_concat(a.words, b.words))) AS sim
  FROM ranked a JOIN ranked b ON a.{group} = b.{group} AND b.rn BETWEEN a.rn - 5 AND a.rn + 5 AND a.rn <> b.rn
  WHERE ({entry.format(t='a')}) IS DISTINCT FROM ({entry.format(t='b')}) AND len(list_concat(a.words, b.words)) > 0),
jw AS (SELECT {group}, {order}, round(avg(sim), 6) AS avg_similarity_in_window, round(max(sim), 6) AS max_similarity_in_window
  FROM {source} LEFT JOIN sims USING ({group}, {order}) GROUP BY {group}, {order})"""


_ENTRY_JACCARD = _jaccard("log_entries", "file", "line_no", "{t}.ts, {t}.level, {t}.source, {t}.message")

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TERMS = f"""tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS t FROM documents),
term AS (SELECT doc_id, unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tok),
counts AS (SELECT doc_id, term, count(*) AS tf FROM term GROUP BY ALL),
vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS count, count(*) AS df FROM counts GROUP BY term
 HAVING count(*) >= 2 AND count(*) <= 0.8 * (SELECT count(*) FROM documents) ORDER BY 2 DESC, 1 LIMIT 1000),
idf AS (SELECT *, ln((1.0 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM vocab)"""


def _all_features_sql() -> str:
    context_columns = ", ".join(f"x.{c}" for c in context.CONTEXT_COLUMNS)
    entropy = "char_entropy, word_entropy, unique_chars, unique_words, avg_word_length"
    return f"""WITH {ENTRIES}, {_TIME_WINDOW}, {_LEVEL_WINDOW}, {_ENTRY_JACCARD},
{_entropy_cte('log_entries', 'line_no')}, {_repeats_cte('log_entries', 'line_no')},
x AS (SELECT * FROM tw JOIN lw USING (line_no) JOIN jw USING (line_no) JOIN ent USING (line_no) LEFT JOIN rep USING (line_no))
SELECT e.file, row_number() OVER (PARTITION BY e.file ORDER BY e.line_no) - 1 AS entry_index, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
 message AS raw_message, {_BASIC_SQL.replace('file ||', 'e.file ||')}, {entropy}, {_pattern_sql()}, {_security_sql()}, {_EXTRA_SQL},
 coalesce(repeated_chars, 0) AS repeated_chars, {context_columns} FROM log_entries e JOIN x USING (line_no)"""


# words of a turn by place and sign, as the hashed encoder has them
_VECTORS = r"""w AS (SELECT conv_id, turn, md5(unnest(regexp_extract_all(lower(text), '[^\t\n\v\f\r ]+'))) AS h FROM conversations),
b AS (SELECT conv_id, turn, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS at, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM w GROUP BY ALL),
l AS (SELECT conv_id, turn, sqrt(sum(v * v)) AS n FROM b GROUP BY ALL)"""

ORACLES = {
    "encode_messages": f"WITH {_VECTORS} SELECT c.conv_id, c.turn, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS embedding_norm FROM conversations c LEFT JOIN l USING (conv_id, turn)",
    "message_similarity": f"""WITH {_VECTORS}, d AS (SELECT x.conv_id, x.turn, sum(x.v * y.v) AS dot FROM b x JOIN b y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 AND y.at = x.at GROUP BY ALL)
 SELECT c.conv_id, c.turn, CASE WHEN p.n > 0 AND q.n > 0 THEN round(coalesce(dot, 0) / (p.n * q.n), 6) END AS similarity FROM conversations c
 JOIN conversations e ON e.conv_id = c.conv_id AND e.turn = c.turn + 1 LEFT JOIN l p ON p.conv_id = c.conv_id AND p.turn = c.turn
 LEFT JOIN l q ON q.conv_id = e.conv_id AND q.turn = e.turn LEFT JOIN d ON d.conv_id = c.conv_id AND d.turn = c.turn""",
    "basic_features": f"WITH {ENTRIES} SELECT line_no, {_BASIC_SQL} FROM log_entries",
    "level_flags": f"WITH {ENTRIES} SELECT line_no, {_LEVEL_SQL} FROM log_entries",
    "temporal_features": f"WITH {ENTRIES} SELECT line_no, {_TIME_SQL} FROM log_entries",
    "char_ratios": f"WITH {TEXTS} SELECT kind, id, {_RATIO_SQL} FROM texts",
    "text_lengths": f"WITH {TEXTS} SELECT kind, id, length(message) AS message_length, {_WORDS} AS word_count FROM texts",
    "char_entropy": _entropy_sql("char_entropy"),
    "word_entropy": _entropy_sql("word_entropy"),
    "unique_tokens": _entropy_sql("unique_chars", "unique_words"),
    "avg_word_length": _entropy_sql("avg_word_length"),
    "pattern_counts": f"WITH {TEXTS} SELECT kind, id, {_pattern_sql()} FROM texts",
    "security_keywords": f"WITH {TEXTS} SELECT kind, id, {_security_sql()} FROM texts",
    "extra_patterns": f"WITH {TEXTS} SELECT kind, id, {_EXTRA_SQL} FROM texts",
    "repeated_chars": f"WITH {TEXTS}, {_repeats_cte('texts', 'kind, id')} SELECT kind, id, coalesce(repeated_chars, 0) AS repeated_chars FROM texts LEFT JOIN rep USING (kind, id)",
    "keyword_label": f"WITH {TEXTS} SELECT kind, id, regexp_matches(lower(message), '{'|'.join(ANOMALY_KEYWORDS)}') AS is_anomaly FROM texts",
    "signature_match": f"WITH {ENTRIES}, {_ALL_TEXTS} SELECT kind, id, {_phrases(ATTACK_SIGNATURES)} AS signatures, {_phrases(ANOMALOUS_PHRASES)} AS anomalous_phrases FROM every",
    "suspicious_ip": f"WITH {ENTRIES} SELECT line_no, message FROM log_entries WHERE list_has_any({_IPS}, [{', '.join(repr(s) for s in SUSPICIOUS)}])",
    "suspicious_ip_semi": f"WITH {ENTRIES}, seen AS (SELECT unnest(regexp_extract_all(text, '{_SQL_PATTERNS['ip_address']}')) AS ip FROM documents "
    f"UNION ALL SELECT unnest({_IPS}) FROM log_entries WHERE is_anomaly), often AS (SELECT ip FROM seen GROUP BY ip HAVING count(*) >= 3), "
    f"named AS (SELECT line_no, unnest({_IPS}) AS ip FROM log_entries) "
    "SELECT line_no, message FROM log_entries WHERE line_no IN (SELECT line_no FROM named WHERE ip IN (SELECT ip FROM often))",
    "embedding_stats": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT vec_id, "
    "round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS embedding_norm, round(list_avg(e), 6) AS embedding_mean, "
    "round(list_aggregate(e, 'stddev_pop'), 6) AS embedding_std, round(list_max(e), 6) AS embedding_max, round(list_min(e), 6) AS embedding_min FROM v",
    "cosine_pairs": "SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), "
    "CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    "top_similar": """WITH s AS (SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]),
 CAST(e.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s) SELECT query, rank, id, similarity FROM r WHERE rank <= 10""",
    "top_similar_messages": r"""WITH m AS (SELECT DISTINCT md5(text) AS id, text FROM conversations WHERE text IS NOT NULL),
 w AS (SELECT id, md5(unnest(regexp_extract_all(lower(text), '[^\t\n\v\f\r ]+'))) AS h FROM m),
 b AS (SELECT id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 64 AS at, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS v FROM w GROUP BY ALL),
 l AS (SELECT id, sqrt(sum(v * v)) AS n FROM b GROUP BY id HAVING n > 0), q AS (SELECT * FROM l WHERE id < '03'),
 d AS (SELECT x.id AS query, y.id, sum(x.v * y.v) AS dot FROM b x JOIN b y ON x.at = y.at WHERE x.id < '03' GROUP BY ALL),
 s AS (SELECT q.id AS query, l.id, round(coalesce(dot, 0) / (q.n * l.n), 6) AS similarity FROM q JOIN l ON l.id <> q.id LEFT JOIN d ON d.query = q.id AND d.id = l.id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, id) AS rank FROM s) SELECT query, rank, id, similarity FROM r WHERE rank <= 3""",
    "message_memo": "SELECT DISTINCT md5(text) AS message_md5, text AS message FROM conversations",
    "time_delta_window": f"WITH {ENTRIES}, {_TIME_WINDOW} SELECT * FROM tw",
    "level_ratio_window": f"WITH {ENTRIES}, {_LEVEL_WINDOW} SELECT line_no, error_ratio_in_window, warn_ratio_in_window FROM lw",
    "unique_sources_window": f"WITH {ENTRIES}, {_LEVEL_WINDOW} SELECT line_no, unique_sources_in_window FROM lw",
    "jaccard_window": f"WITH {ENTRIES}, {_ENTRY_JACCARD} SELECT line_no, avg_similarity_in_window, max_similarity_in_window FROM jw",
    "conversation_context": "WITH turns AS (SELECT conv_id, turn, role, text AS message FROM conversations), "
    + _jaccard("turns", "conv_id", "turn", "{t}.role, {t}.message")
    + " SELECT conv_id, turn, avg_similarity_in_window, max_similarity_in_window FROM jw",
    "all_features": _all_features_sql(),
    "entry_index": f"WITH {ENTRIES} SELECT file, line_no, row_number() OVER (PARTITION BY file ORDER BY line_no) - 1 AS entry_index FROM log_entries",
    "chunk_counts": f"WITH {ENTRIES}, i AS (SELECT *, (row_number() OVER (PARTITION BY file ORDER BY line_no) - 1) // 100 AS batch FROM log_entries) "
    "SELECT file, batch, count(*) AS total, CAST(sum(CAST(is_anomaly AS INT)) AS BIGINT) AS anomalies FROM i GROUP BY ALL",
    "tfidf_vocabulary": f"WITH {_TERMS} SELECT term, count, df, round(idf, 6) AS idf FROM idf",
    "tfidf_weights": f"WITH {_TERMS}, w AS (SELECT doc_id, term, tf * idf AS w FROM counts JOIN idf USING (term)) "
    "SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w",
    "rare_words": f"WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[^{WS}]+')) AS word FROM documents), "
    "df AS (SELECT word FROM w GROUP BY word HAVING count(*) <= 2), n AS (SELECT doc_id, count(*) AS rare_words FROM w JOIN df USING (word) GROUP BY doc_id) "
    "SELECT doc_id, coalesce(rare_words, 0) AS rare_words FROM documents LEFT JOIN n USING (doc_id)",
}
