"""Row filters and phrase matches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievelog.functions.patterns import (
    ANOMALOUS_PHRASES,
    ANOMALY_KEYWORDS,
    ATTACK_SIGNATURES,
    SUSPICIOUS_IPS,
    ip_addresses,
    matched_phrases,
)
from sievelog.operators.lookup import spread_lookup


def above_threshold(df: DataFrame, threshold: float, score: str = "anomaly_score") -> DataFrame:
    """Scores strictly above the threshold."""
    return df.where(F.col(score) > threshold)


def anomalies_only(df: DataFrame, width: int = 100, message: str = "message") -> DataFrame:
    """Anomalous rows with the message cut for reporting."""
    return df.where("is_anomaly").withColumn(message, F.substring(F.col(message), 1, width))


def keyword_label(raw: Column, keywords: Sequence[str] = ANOMALY_KEYWORDS) -> Column:
    """True when the case-folded line holds any of the keywords."""
    lowered = F.lower(raw)
    hit = F.contains(lowered, F.lit(keywords[0]))
    for keyword in keywords[1:]:
        hit = hit | F.contains(lowered, F.lit(keyword))
    return hit


def signature_matches(
    df: DataFrame,
    message: str = "message",
    signatures: Sequence[str] = ATTACK_SIGNATURES,
    phrases: Sequence[str] = ANOMALOUS_PHRASES,
) -> DataFrame:
    """Add the attack signatures and anomalous phrases each message holds."""
    m = F.col(message)
    return df.withColumns(
        {
            "signatures": matched_phrases(m, signatures),
            "anomalous_phrases": matched_phrases(m, phrases),
        }
    )


def from_suspicious_ip(
    df: DataFrame,
    message: str = "message",
    suspicious: Sequence[str] | DataFrame = SUSPICIOUS_IPS,
    key: str | None = None,
) -> DataFrame:
    """Rows that mention an address on the list.

    A list of literals is tested inside the row. A table of addresses (column ``ip``) is joined on the address,
    the rows of one address spread by their ``key``, so an address most lines mention is not one task's work.
    """
    m = F.col(message)
    addresses = F.when(m.contains("."), ip_addresses(m))
    if not isinstance(suspicious, DataFrame):
        listed = F.array(*[F.lit(ip) for ip in suspicious])
        return df.where(F.arrays_overlap(addresses, listed))
    if key is None:
        raise ValueError("matching against a table needs the row key")
    pairs = df.select(key, F.explode(F.array_distinct(addresses)).alias("ip"))
    listed = suspicious.select("ip").distinct()
    hits = spread_lookup(pairs, ["ip"], listed, [key], "left_semi").select(key).distinct()
    return df.join(hits, key, "left_semi")
