"""Timestamp text to wall-clock and instant columns.

Every readable shape is first rewritten as ISO text with plain string functions, then cast. A cast that fails
gives null; a formatter that fails raises and catches an exception per row, which is far slower.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ISO = r"^\d{4}-\d"
_CLF = r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2}\s+(?:Z|[+-]\d{2}:?\d{2})$"
_SYSLOG = r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"
# free forms accepted after the listed formats
_YEAR_FIRST = r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$"
_MONTH_FIRST = r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}:\d{2}:\d{2})$"
_NAME_FIRST = r"^[A-Za-z]{3} \d{1,2},? \d{4} \d{1,2}:\d{2}:\d{2}$"
_DAY_FIRST = r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}:\d{2}$"

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _month(name: Column) -> Column:
    at = F.position(F.lower(name), F.lit(_MONTHS))
    return F.when(at % 3 == 1, ((at + 2) / 3).cast("int").cast("string"))


def _iso(year, month, day, clock, offset=None) -> Column:
    dash = F.lit("-")
    parts = [year, dash, month, dash, day, F.lit("T"), clock]
    return F.concat(*parts, offset) if offset is not None else F.concat(*parts)


def iso_text(text: Column, default_year: int = 1900) -> Column:
    """``text`` rewritten as ISO where its shape is known, else unchanged."""
    clf = F.split(text, r"[/:\s]", 6)
    clf_rest = F.split(clf[5], r"\s+", 2)
    syslog = F.split(text, r"\s+")
    named = F.split(F.replace(text, F.lit(","), F.lit("")), " ")
    return (
        F.when(text.rlike(_ISO), F.replace(text, F.lit(","), F.lit(".")))
        .when(
            text.rlike(_CLF),
            _iso(
                clf[2],
                _month(clf[1]),
                clf[0],
                F.concat_ws(":", clf[3], clf[4], clf_rest[0]),
                clf_rest[1],
            ),
        )
        .when(text.rlike(_SYSLOG), _iso(F.lit(str(default_year)), _month(syslog[0]), syslog[1], syslog[2]))
        .when(text.rlike(_YEAR_FIRST), F.replace(text, F.lit("/"), F.lit("-")))
        .when(text.rlike(_MONTH_FIRST), F.regexp_replace(text, _MONTH_FIRST, "$3-$1-$2 $4"))
        .when(text.rlike(_NAME_FIRST), _iso(named[2], _month(named[0]), named[1], named[3]))
        .when(text.rlike(_DAY_FIRST), _iso(named[2], _month(named[1]), named[0], named[3]))
        .otherwise(text)
    )


def wall_clock(iso: Column) -> Column:
    """The clock reading as written, without its offset (``TIMESTAMP_NTZ``); null when unreadable."""
    return iso.try_cast("timestamp_ntz")


def instant(iso: Column) -> Column:
    """The instant (``TIMESTAMP``): offsets are honoured, naive text is read in the session time zone."""
    return iso.try_cast("timestamp")


def parse_timestamp(df, column: str, default_year: int = 1900):
    """Add ``ts`` and ``ts_wall`` for the timestamp text in ``column``."""
    iso = F.col("_iso")
    return (
        df.withColumn("_iso", iso_text(F.col(column), default_year))
        .withColumns({"ts": instant(iso), "ts_wall": wall_clock(iso)})
        .drop("_iso")
    )
