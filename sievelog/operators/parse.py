"""Raw lines to typed log entries.

One detection cascade per line, then one extraction pass for the branch that matched: a line's groups are
rewritten into a single delimited string whose delimiter cannot occur inside the group before it, so the
expression engine scans the line once per branch and not once per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievelog.functions import timestamps as tm
from sievelog.functions.text import NON_WS, SPACE, WORD, after_bracket, is_blank, strip

_S = f"{NON_WS}+"
_WORD = f"{NON_WS}++"  # followed by a blank, so it never has to give characters back

# fixed values: line shapes, tried in this order; anchored at the start of the stripped line only
ACCESS = rf'({_WORD}) {_WORD} {_WORD} \[([^\]]+)\] "({_WORD}) ({_WORD}) ({_S})" (\p{{Nd}}++) ({_S})'
SYSLOG = rf"({WORD}+{SPACE}+\p{{Nd}}+{SPACE}+\p{{Nd}}+:\p{{Nd}}+:\p{{Nd}}+) ({_WORD}) ({_S}): (.*)"
COMBINED = (
    rf'({_WORD}) - {_WORD} \[([^\]]+)\] "({_WORD}) ({_WORD}) ({_S})" (\p{{Nd}}++) (\p{{Nd}}++) '
    r'"([^"]*)" "([^"]*)"'
)
_LEVELS = "DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL"
_LEVELS_LONGEST_FIRST = "DEBUG|INFO|WARNING|WARN|ERROR|FATAL|CRITICAL"


def application_pattern(strict_levels: bool = False) -> str:
    """The application shape; ``strict_levels`` reads WARNING as one level instead of WARN plus ``ING``."""
    levels = _LEVELS_LONGEST_FIRST if strict_levels else _LEVELS
    clock = (
        rf"\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}{SPACE}+"
        rf"\p{{Nd}}{{2}}:\p{{Nd}}{{2}}:\p{{Nd}}{{2}}[,\.]?\p{{Nd}}*"
    )
    return (
        rf"({clock}){SPACE}+\[?({levels})\]?{SPACE}*(?:\[([^\]]+)\])?{SPACE}*"
        rf"({_S})?{SPACE}*[-:]?{SPACE}*(.*)"
    )


def _starts(line: Column, pattern: str) -> Column:
    return line.rlike(f"(?d)^{pattern}")


def _rewrite(line: Column, pattern: str, layout: str) -> Column:
    return F.regexp_replace(line, f"(?d)^{pattern}(?s:.*)$", layout)


def _nonempty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def detect_format(line: Column, combined: bool = False, strict_levels: bool = False) -> Column:
    """Name of the first shape the stripped line starts with; null when none does.

    ``combined`` puts the referer/user-agent shape ahead of the plain access shape, which it extends.
    """
    # a literal every match must hold is tested first: it spares most lines the pattern
    quoted = line.contains('] "')
    braces = line.startswith("{") & line.endswith("}") & ~line.contains("\n")
    out = F
    if combined:
        out = out.when(quoted & _starts(line, COMBINED), "nginx")
    return (
        out.when(quoted & _starts(line, ACCESS), "apache")
        .when(line.contains(": ") & _starts(line, SYSLOG), "syslog")
        .when(_starts(line, application_pattern(strict_levels)), "application")
        .when(quoted & _starts(line, COMBINED), "nginx")
        .when(braces, "json")
    )


def nonblank(df: DataFrame, column: str = "value") -> DataFrame:
    """Keep the lines that hold anything but white space."""
    return df.where(~is_blank(F.col(column)))


def message_after_bracket(df: DataFrame, column: str = "value", out: str = "message") -> DataFrame:
    return df.withColumn(out, after_bracket(F.col(column)))


def _variant_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _first_key(obj: Column, *keys: str) -> Column:
    """Value of the first key that is *present*; a present null wins over a later key."""
    out = F.when(F.map_contains_key(obj, keys[0]), obj[keys[0]])
    for key in keys[1:]:
        out = out.when(F.map_contains_key(obj, key), obj[key])
    return out


def _has_any(obj: Column, *keys: str) -> Column:
    out = F.map_contains_key(obj, keys[0])
    for key in keys[1:]:
        out = out | F.map_contains_key(obj, key)
    return out


def _last_of_each_key(obj: Column) -> Column:
    """The map a JSON object with repeated keys stands for: the last value of a key counts."""
    keys = F.array_distinct(F.map_keys(obj))
    last = F.transform(
        keys, lambda k: F.element_at(F.filter(F.map_entries(obj), lambda e: e["key"] == k), -1)["value"]
    )
    return F.map_from_arrays(keys, last)


def _json_branch(df: DataFrame) -> DataFrame:
    """Decode JSON lines once; other lines carry nulls through at no cost."""
    # the line is read as a one-element list so that trailing text after the object is an error
    boxed = F.from_json(
        F.when(F.col("_format") == "json", F.concat(F.lit("["), F.col("_line"), F.lit("]"))),
        "array<map<string,variant>>",
        {"allowSingleQuotes": "false"},
    )
    df = df.withColumn("_boxed", boxed)
    obj = F.when(F.size("_boxed") == 1, F.col("_boxed")[0])
    keys = F.map_keys(obj)
    repeated = F.size(F.array_distinct(keys)) < F.size(keys)
    df = df.withColumn("_obj", F.when(repeated, _last_of_each_key(obj)).otherwise(obj))
    obj = F.col("_obj")
    time_value = _first_key(obj, "timestamp", "@timestamp", "time")
    level_value = _first_key(obj, "level", "severity")
    message_value = _first_key(obj, "message", "msg")
    source_value = _first_key(obj, "source", "logger", "service")
    return df.withColumn(
        "_json",
        F.when(
            obj.isNotNull(),
            F.struct(
                F.schema_of_variant(time_value).alias("time_type"),
                _variant_text(time_value).alias("time"),
                F.when(_has_any(obj, "level", "severity"), F.schema_of_variant(level_value))
                .otherwise("absent")
                .alias("level_type"),
                _variant_text(level_value).alias("level"),
                F.when(_has_any(obj, "message", "msg"), _variant_text(message_value))
                .otherwise(F.col("_line"))
                .alias("message"),
                F.when(_has_any(obj, "source", "logger", "service"), _variant_text(source_value))
                .otherwise("unknown")
                .alias("source"),
            ),
        ),
    ).drop("_boxed", "_obj")


def _reject_reason() -> Column:
    j = F.col("_json")
    falsy = (
        j["time_type"].isNull()
        | (j["time_type"] == "VOID")
        | j["time"].isNull()
        | j["time"].isin("", "0", "false", "{}", "[]", "0.0", "-0.0")
    )
    is_json = F.col("_format") == "json"
    return (
        F.when(is_json & j.isNull(), "malformed_json")
        .when(is_json & ~falsy & (j["time_type"] != "STRING"), "json_time_not_text")
        .when(is_json & ~j["level_type"].isin("STRING", "absent"), "json_level_not_text")
    )


def _decoded(df: DataFrame, column: str, combined: bool, strict_levels: bool) -> DataFrame:
    """Add the stripped line, its format, its cut-out groups and the decoded JSON fields."""
    line, fmt, cut = F.col("_line"), F.col("_format"), F.col("_cut")
    df = df.withColumn("_raw", F.col(column)).withColumn("_line", strip(F.col(column)))
    shape = detect_format(line, combined, strict_levels)
    if not combined:
        # without the opt-in there is no reader for the combined shape; such lines stay free text
        shape = F.nullif(shape, F.lit("nginx"))
    df = df.withColumn("_format", shape)
    layout = (
        # the time holds no ']' and the words after it no blank
        F.when(fmt == "apache", F.split(_rewrite(line, ACCESS, "$2]$1 $3 $4 $5 $6 $7"), r"\]", 2))
        # host and process hold no blank, the time after them no ']'
        .when(fmt == "syslog", F.split(_rewrite(line, SYSLOG, "$2 $3 $1]$4"), " ", 3))
        .when(
            fmt == "application",
            F.split(_rewrite(line, application_pattern(strict_levels), "$1]$2]$3]$4 $5"), r"\]", 4),
        )
    )
    if combined:
        # the words before the line break hold no white space, the referer after it no quote
        layout = layout.when(
            fmt == "nginx",
            F.split(_rewrite(line, COMBINED, '$2]$1 $3 $4 $5 $6 $7\n$8"$9'), r"\]", 2),
        )
    df = _json_branch(df.withColumn("_cut", layout))
    words = (
        F.when(fmt == "syslog", cut)
        .when(fmt == "application", F.split(cut[3], " ", 2))
        .when(fmt == "apache", F.split(cut[1], " ", 6))
    )
    if combined:
        words = words.when(fmt == "nginx", F.split(F.substring_index(cut[1], "\n", 1), " ", 6))
    return df.withColumn("_words", words)


def _one_or_none(df: DataFrame, keep: list[str], condition: Column, fields: list[Column]) -> DataFrame:
    """One row of ``fields`` where ``condition`` holds, none elsewhere.

    Written as a generator and not as a filter: the optimizer would copy a filter on decoded fields below the
    projection that decodes them and run every pattern twice.
    """
    chosen = F.array_compact(F.array(F.when(condition, F.struct(*fields))))
    return df.select(*keep, F.explode(chosen).alias("_p"))


def _clock(combined: bool) -> Column:
    p = F.col("_p")
    fmt = p["_format"]
    access = fmt.isin("apache", "nginx") if combined else fmt == "apache"
    return (
        F.when(access | (fmt == "application"), p["_cut"][0])
        .when(fmt == "syslog", F.substring_index(p["_words"][2], "]", 1))
        .when(fmt == "json", _nonempty(p["_json"]["time"]))
    )


def _entry_columns(ingest_ts: Column, combined: bool) -> list[Column]:
    p = F.col("_p")
    fmt, cut, w, j, line = p["_format"], p["_cut"], p["_words"], p["_json"], p["_line"]
    access = fmt.isin("apache", "nginx") if combined else fmt == "apache"
    clock = F.col("_clock")
    has_json_time = (fmt == "json") & (j["time_type"] == "STRING") & clock.isNotNull()
    stamp = ingest_ts.cast("timestamp")
    # an unreadable JSON time stays null; every other shape falls back to the ingestion time
    ts = F.when(has_json_time, tm.instant(clock)).otherwise(
        F.coalesce(F.when(fmt != "json", tm.instant(clock)), stamp)
    )
    wall = F.when(has_json_time, tm.wall_clock(clock)).otherwise(
        F.coalesce(F.when(fmt != "json", tm.wall_clock(clock)), stamp.cast("timestamp_ntz"))
    )

    syslog_message = F.substring(w[2], F.locate("]", w[2]) + 1, F.length(w[2]))
    level = (
        F.when(fmt == "application", cut[1]).when(fmt == "json", F.upper(F.coalesce(j["level"], F.lit("INFO"))))
    ).otherwise("INFO")
    source = (
        F.when(access, fmt)
        .when(fmt == "syslog", w[0])
        .when(fmt == "application", _nonempty(w[0]))
        .when(fmt == "json", j["source"])
        .otherwise("unknown")
    )
    message = (
        F.when(access, F.concat_ws(" ", w[1], w[2], w[3], F.lit("-"), w[4]))
        .when(fmt == "syslog", syslog_message)
        .when(fmt == "application", w[1])
        .when(fmt == "json", j["message"])
        .otherwise(line)
    )
    request = [
        w[0].alias("ip"),
        w[1].alias("method"),
        w[2].alias("path"),
        w[4].try_cast("bigint").alias("status"),
        w[5].alias("size"),
    ]
    metadata = F.when(fmt == "apache", F.to_json(F.struct(*request)))
    if combined:
        agents = F.split(F.substring(cut[1], F.locate("\n", cut[1]) + 1, F.length(cut[1])), '"', 2)
        metadata = metadata.when(
            fmt == "nginx",
            F.to_json(F.struct(*request, agents[0].alias("referer"), agents[1].alias("user_agent"))),
        )
    metadata = (
        metadata.when(fmt == "syslog", F.to_json(F.struct(w[0].alias("hostname"), w[1].alias("process"))))
        .when(
            fmt == "application",
            F.to_json(
                F.struct(_nonempty(cut[2]).alias("thread"), _nonempty(w[0]).alias("logger")),
                {"ignoreNullFields": "false"},
            ),
        )
        .when(fmt == "json", line)
        .otherwise("{}")
    )
    return [
        ts.alias("ts"),
        wall.alias("ts_wall"),
        level.alias("level"),
        source.alias("source"),
        message.alias("message"),
        p["_raw"].alias("raw_log"),
        metadata.alias("metadata"),
        F.coalesce(fmt, F.lit("generic")).alias("format"),
    ]


def parse_logs(
    df: DataFrame,
    column: str = "value",
    *,
    ingest_ts: Column | None = None,
    default_year: int = 1900,
    strict_levels: bool = False,
    combined: bool = False,
) -> DataFrame:
    """Parse every non-blank line of ``column``; the other columns are carried along.

    Lines that cannot become an entry are left out here and listed by :func:`parse_rejects`. Works the same
    on batch and streaming inputs.
    """
    ingest_ts = F.current_timestamp() if ingest_ts is None else ingest_ts
    keep = [c for c in df.columns if c != column]
    decoded = _decoded(df, column, combined, strict_levels)
    fields = [F.col(c) for c in ("_line", "_raw", "_format", "_cut", "_words", "_json")]
    kept = _one_or_none(decoded, keep, (F.col("_line") != "") & _reject_reason().isNull(), fields)
    kept = kept.withColumn("_clock", _clock(combined))
    kept = kept.withColumn("_clock", tm.iso_text(F.col("_clock"), default_year))
    return kept.select(*keep, *_entry_columns(ingest_ts, combined))


def parse_rejects(df: DataFrame, column: str = "value") -> DataFrame:
    """Quarantine: the lines :func:`parse_logs` leaves out, with the reason."""
    keep = [c for c in df.columns if c != column]
    decoded = _decoded(df, column, False, False).withColumn("_reason", _reject_reason())
    fields = [F.col("_raw").alias("raw_log"), F.col("_reason").alias("reason")]
    return _one_or_none(decoded, keep, F.col("_reason").isNotNull(), fields).select(*keep, "_p.*")


def export_entries(entries: DataFrame) -> DataFrame:
    """The six-column entry table, metadata as JSON text."""
    return entries.select(
        F.col("ts_wall").alias("timestamp"), "level", "source", "message", "raw_log", "metadata"
    )
