"""Pattern and keyword dictionaries with the column expressions that count them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from sievelog.functions.text import count_substring


@dataclass(frozen=True)
class Pattern:
    """A pattern and a literal that any match must hold, tested first because it is cheap."""

    regex: str
    needs: tuple[str, ...] = ()


# fixed values: what counts as each pattern. Groups that repeat are possessive, which keeps the matcher iterative
# on long text; nothing follows them, so the matches are the same.
PATTERNS: dict[str, Pattern] = {
    "ip_address": Pattern(r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", (".",)),
    "email": Pattern(r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", ("@",)),
    "url": Pattern(r"https?://[!$-_a-z]+", ("://",)),
    "file_path": Pattern(
        r'[A-Za-z]:\\(?:[^\\/:*?"<>|\r\n]++\\)*+[^\\/:*?"<>|\r\n]*+|/(?:[^/\x00]++/)*+[^/\x00]*+',
        ("/", "\\"),
    ),
    "hash": Pattern(r"(?U)\b[a-fA-F0-9]{32,64}\b"),
    "sql_keywords": Pattern(r"(?iU)\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|UNION|WHERE|FROM)\b"),
    "script_tags": Pattern(r"(?is)<script[^>]*>.*?</script>", ("<",)),
}

# fixed values: security vocabulary by category, matched as case-folded substrings
SECURITY_KEYWORDS: dict[str, tuple[str, ...]] = {
    "attack": ("injection", "xss", "csrf", "exploit", "malware", "virus", "trojan"),
    "access": ("unauthorized", "forbidden", "denied", "privilege", "escalation"),
    "authentication": ("login", "logout", "password", "credential", "token", "session"),
    "network": ("scan", "probe", "brute force", "ddos", "flood"),
    "system": ("crash", "error", "exception", "failure", "timeout"),
}

# fixed values: words that mark a raw line as anomalous, and the phrase lists of the detection settings
ANOMALY_KEYWORDS = ("failed", "error", "critical", "injection", "unauthorized")
ATTACK_SIGNATURES = ("sql injection", "xss", "path traversal", "buffer overflow")
ANOMALOUS_PHRASES = (
    "failed login",
    "unauthorized access",
    "privilege escalation",
    "unusual user agent",
)
SUSPICIOUS_IPS = ("192.168.1.100", "10.0.0.50")


def pattern_count(text: Column, pattern: Pattern) -> Column:
    count = F.regexp_count(text, F.lit(pattern.regex))
    if not pattern.needs:
        return count
    possible = text.contains(pattern.needs[0])
    for literal in pattern.needs[1:]:
        possible = possible | text.contains(literal)
    return F.when(possible, count).otherwise(F.when(text.isNotNull(), F.lit(0)))


def keyword_count(lowered: Column, keywords: Sequence[str]) -> Column:
    """Occurrences of each keyword, added up; keywords are counted independently and may overlap.

    Only those that occur are counted: finding out is much cheaper than a replacement. The fold over the list also keeps
    the generated code short; one expression per keyword made a method too long for the JVM to compile.
    """
    found = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(lowered, k))
    total = F.aggregate(found, F.lit(0), lambda acc, k: acc + count_substring(lowered, k))
    return F.when(lowered.isNotNull(), total)


def repeated_chars(text: Column) -> Column:
    """Runs of three or more equal characters; line breaks do not count."""
    return F.regexp_count(text, F.lit(r"(?d)(.)\1{2,}"))


def flag(condition: Column) -> Column:
    return condition.cast("int")


def matched_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases found in the case-folded text, in list order."""
    lowered = F.lower(text)
    return F.array_compact(
        F.array(*[F.when(F.contains(lowered, F.lit(p)), F.lit(p)) for p in phrases])
    )


def ip_addresses(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PATTERNS['ip_address'].regex})"), F.lit(1))


Keywords = Mapping[str, Sequence[str]]
