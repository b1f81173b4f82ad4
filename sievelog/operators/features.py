"""Row features of log entries. Every function appends columns, shuffles nothing, and also works on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievelog.functions import entropy as en
from sievelog.functions.patterns import (
    PATTERNS,
    SECURITY_KEYWORDS,
    Keywords,
    flag,
    keyword_count,
    pattern_count,
    repeated_chars,
)
from sievelog.functions.text import (
    ALNUM,
    DIGITS,
    LETTERS,
    UPPER,
    WS,
    count_class,
    count_outside,
    ratio,
    word_count,
)


def temporal_features(df: DataFrame, wall: str = "ts_wall") -> DataFrame:
    """Hour, weekday (Monday = 0) and weekend flag of the entry's own clock reading."""
    day = F.weekday(F.col(wall))
    return df.withColumns(
        {"hour": F.hour(F.col(wall)), "day_of_week": day, "is_weekend": day >= 5}
    )


def level_flags(df: DataFrame, level: str = "level") -> DataFrame:
    c = F.coalesce(F.col(level), F.lit(""))
    return df.withColumns(
        {
            "log_level_info": flag(c == "INFO"),
            "log_level_warn": flag(c.isin("WARN", "WARNING")),
            "log_level_error": flag(c.isin("ERROR", "CRITICAL", "FATAL")),
            "log_level_debug": flag(c == "DEBUG"),
        }
    )


def length_features(df: DataFrame, message: str = "message", raw: str | None = "raw_log") -> DataFrame:
    m = F.col(message)
    columns = {
        "message_length": F.length(m),
        "word_count": word_count(m),
        "char_count": F.length(m),
    }
    if raw:
        columns["line_length"] = F.length(F.col(raw))
    return df.withColumns(columns)


def char_ratios(df: DataFrame, message: str = "message") -> DataFrame:
    """Shares of digits, letters, upper-case letters and of neither-alphanumeric-nor-space characters."""
    m = F.col(message)
    return df.withColumns(
        {
            "digit_ratio": ratio(count_class(m, DIGITS), m),
            "alpha_ratio": ratio(count_class(m, LETTERS), m),
            "upper_ratio": ratio(count_class(m, UPPER), m),
            "special_char_ratio": ratio(count_outside(m, ALNUM + WS), m),
        }
    )


def basic_features(df: DataFrame, message: str = "message", raw: str | None = "raw_log") -> DataFrame:
    return char_ratios(length_features(level_flags(temporal_features(df)), message, raw), message)


def entropy_features(df: DataFrame, message: str = "message") -> DataFrame:
    """Entropy, distinct counts and mean word length over characters and words."""
    return en.with_entropy(df, message)


def pattern_counts(df: DataFrame, message: str = "message", patterns=None) -> DataFrame:
    """``count_<name>`` and ``has_<name>`` for each pattern; every pattern is run once."""
    patterns = PATTERNS if patterns is None else patterns
    m = F.col(message)
    df = df.withColumns({f"count_{name}": pattern_count(m, p) for name, p in patterns.items()})
    return df.withColumns({f"has_{name}": flag(F.col(f"count_{name}") > 0) for name in patterns})


def security_keywords(
    df: DataFrame, message: str = "message", keywords: Keywords = SECURITY_KEYWORDS
) -> DataFrame:
    """``security_<category>_count`` and ``has_security_<category>``."""
    df = df.withColumn("_lowered", F.lower(F.col(message)))
    lowered = F.col("_lowered")
    df = df.withColumns(
        {f"security_{c}_count": keyword_count(lowered, k) for c, k in keywords.items()}
    ).drop("_lowered")
    return df.withColumns(
        {f"has_security_{c}": flag(F.col(f"security_{c}_count") > 0) for c in keywords}
    )


def extra_patterns(df: DataFrame, message: str = "message") -> DataFrame:
    m = F.col(message)
    return df.withColumns(
        {
            "has_numbers": flag(m.rlike(r"\p{Nd}")),
            "has_uppercase": flag(m.rlike("[A-Z]")),
            "has_brackets": flag(m.rlike(r"[\[\]{}()]")),
            "has_quotes": flag(m.rlike("[\"']")),
            "repeated_chars": repeated_chars(m),
            "consecutive_spaces": F.regexp_count(m, F.lit(" {2,}")),
        }
    )


def pattern_features(df: DataFrame, message: str = "message") -> DataFrame:
    return extra_patterns(security_keywords(pattern_counts(df, message), message), message)


def row_features(df: DataFrame, message: str = "message", raw: str | None = "raw_log") -> DataFrame:
    """Basic, entropy and pattern features together."""
    return pattern_features(entropy_features(basic_features(df, message, raw), message), message)


def request_fields(df: DataFrame, metadata: str = "metadata") -> DataFrame:
    """Source address, user agent, request path and response code of access-log entries."""
    fields = F.from_json(
        F.col(metadata), "ip string, user_agent string, path string, status int"
    )
    return (
        df.withColumn("_request", fields)
        .withColumns(
            {
                "source_ip": F.col("_request.ip"),
                "user_agent": F.col("_request.user_agent"),
                "request_path": F.col("_request.path"),
                "response_code": F.col("_request.status"),
            }
        )
        .drop("_request")
    )
