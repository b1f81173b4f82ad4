"""Registered queries: parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sievelog.functions.timestamps import parse_timestamp
from sievelog.operators import parse as P
from sievelog.operators.features import request_fields
from sievelog.plans.views import log_lines, table
from sievelog.plans.views_sql import LINES, wall

INGEST = "2024-01-01 00:00:00"


def wall_text(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _parsed(spark, sf_dir, **options) -> DataFrame:
    ingest = F.lit(INGEST).cast("timestamp")
    return P.parse_logs(log_lines(spark, sf_dir), "line", ingest_ts=ingest, default_year=2024, **options)


def _out(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id",
        wall_text("ts_wall").alias("ts_wall"),
        "level",
        "source",
        "message",
        "metadata",
        "format",
    )


def _of_format(name: str):
    return lambda spark, sf_dir: _out(_parsed(spark, sf_dir).where(F.col("format") == name))


def detect_format(spark, sf_dir):
    lines = P.nonblank(log_lines(spark, sf_dir), "line")
    return lines.select("event_id", P.detect_format(P.strip(F.col("line"))).alias("format"))


def nonblank_filter(spark, sf_dir):
    return P.nonblank(log_lines(spark, sf_dir), "line").select("event_id", "line")


def message_after_bracket(spark, sf_dir):
    return P.message_after_bracket(log_lines(spark, sf_dir), "line").select("event_id", "message")


def timestamps(spark, sf_dir):
    """Every event's time written in each accepted shape, read back."""
    ts = F.col("ts")
    shapes = F.create_map(
        F.lit("dashed"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        F.lit("point"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        F.lit("comma"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS"),
        F.lit("access"), F.date_format(ts, "dd/MMM/yyyy:HH:mm:ss '+0530'"),
        F.lit("syslog"), F.date_format(ts, "MMM dd HH:mm:ss"),
        F.lit("zulu"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("zulu_point"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
        F.lit("offset"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'-02:00'"),
        F.lit("named"), F.date_format(ts, "d MMM yyyy HH:mm:ss"),
        F.lit("unreadable"), F.date_format(ts, "'at' HH:mm"),
    )
    df = table(spark, sf_dir, "events").select("event_id", F.explode(shapes).alias("shape", "text"))
    parsed = parse_timestamp(df, "text", default_year=2024)
    return parsed.select(
        "event_id", "shape", wall_text("ts_wall").alias("ts_wall"), F.unix_micros("ts").alias("ts_micros")
    )


def parse_logs(spark, sf_dir):
    return _out(_parsed(spark, sf_dir))


def parse_rejects(spark, sf_dir):
    return P.parse_rejects(log_lines(spark, sf_dir), "line").select("event_id", "raw_log", "reason")


def _combined_lines(spark, sf_dir):
    lines = log_lines(spark, sf_dir)
    extra = F.concat(
        F.lit(' "https://ref.example/'), F.col("event_id").cast("string"), F.lit('" "Agent/1.0 (x)"')
    )
    is_access = F.col("line").contains("HTTP/1.1")
    return lines.withColumn("line", F.when(is_access, F.concat("line", extra)).otherwise(F.col("line")))


def parse_combined_access(spark, sf_dir):
    ingest = F.lit(INGEST).cast("timestamp")
    parsed = P.parse_logs(
        _combined_lines(spark, sf_dir), "line", ingest_ts=ingest, default_year=2024, combined=True
    )
    return _out(parsed.where("format = 'nginx'"))


def request_feature_fields(spark, sf_dir):
    ingest = F.lit(INGEST).cast("timestamp")
    parsed = P.parse_logs(
        _combined_lines(spark, sf_dir), "line", ingest_ts=ingest, default_year=2024, combined=True
    )
    return request_fields(parsed).select(
        "event_id", "source_ip", "user_agent", "request_path", "response_code"
    )


def entry_table_export(spark, sf_dir):
    exported = P.export_entries(_parsed(spark, sf_dir))
    return exported.withColumn("timestamp", wall_text("timestamp"))


def level_by_source_hour(spark, sf_dir):
    """Lines and error share per source and hour of the parsed log."""
    parsed = _parsed(spark, sf_dir)
    is_error = F.col("level").isin("ERROR", "CRITICAL", "FATAL").cast("int")
    return parsed.groupBy("source", F.hour("ts_wall").alias("hour")).agg(
        F.count(F.lit(1)).alias("lines"), F.round(F.avg(is_error), 6).alias("error_ratio")
    )


QUERIES = {
    "detect_format": detect_format,
    "parse_timestamp": timestamps,
    "parse_json_lines": _of_format("json"),
    "parse_access_lines": _of_format("apache"),
    "parse_syslog_lines": _of_format("syslog"),
    "parse_application_lines": _of_format("application"),
    "parse_generic_lines": _of_format("generic"),
    "parse_logs": parse_logs,
    "parse_rejects": parse_rejects,
    "parse_combined_access": parse_combined_access,
    "request_fields": request_feature_fields,
    "message_after_bracket": message_after_bracket,
    "nonblank_filter": nonblank_filter,
    "entry_table_export": entry_table_export,
    "level_by_source_hour": level_by_source_hour,
}

_ACCESS = r'^(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\S+)'
_COMBINED = r'^(\S+) - \S+ \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+) "([^"]*)" "([^"]*)"'
_SYSLOG = r"^(\w+\s+\d+\s+\d+:\d+:\d+) (\S+) (\S+): (.*)"
_APP = (
    r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}[,\.]?\d*)\s+"
    r"\[?(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|CRITICAL)\]?\s*(?:\[([^\]]+)\])?\s*(\S+)?\s*[-:]?\s*(.*)"
)


def _g(pattern: str, group: int, text: str = "t") -> str:
    return f"regexp_extract({text}, '{pattern}', {group})"


def _format_case(combined: bool) -> str:
    first = f"WHEN regexp_matches(t, '{_COMBINED}') THEN 'nginx'" if combined else ""
    return f"""CASE {first} WHEN regexp_matches(t, '{_ACCESS}') THEN 'apache'
 WHEN regexp_matches(t, '{_SYSLOG}') THEN 'syslog' WHEN regexp_matches(t, '{_APP}') THEN 'application'
 WHEN regexp_matches(t, '^\\{{.*\\}}$') THEN 'json' END"""


def _quoted(pairs) -> str:
    """Compact JSON object text from name and value expressions."""
    cells = [f"""'"{k}":"' || {v} || '"'""" if q else f"""'"{k}":' || {v}""" for k, v, q in pairs]
    return "'{' || " + " || ',' || ".join(cells) + " || '}'"


def _parsed_sql(combined: bool = False, lines: str = "log_lines") -> str:
    apache = [("ip", _g(_ACCESS, 1), 1), ("method", _g(_ACCESS, 3), 1), ("path", _g(_ACCESS, 4), 1),
              ("status", _g(_ACCESS, 6), 0), ("size", _g(_ACCESS, 7), 1)]
    nginx = [("ip", _g(_COMBINED, 1), 1), ("method", _g(_COMBINED, 3), 1), ("path", _g(_COMBINED, 4), 1),
             ("status", _g(_COMBINED, 6), 0), ("size", _g(_COMBINED, 7), 1),
             ("referer", _g(_COMBINED, 8), 1), ("user_agent", _g(_COMBINED, 9), 1)]
    null_or = "CASE WHEN {0} = '' THEN 'null' ELSE '\"' || {0} || '\"' END"
    return f"""{LINES}, stripped AS (SELECT *, trim(line) AS t FROM {lines} WHERE trim(line) <> ''),
shaped AS (SELECT *, {_format_case(combined)} AS f FROM stripped),
parsed AS (SELECT event_id, t, line AS raw_log, coalesce(f, 'generic') AS format,
 CASE WHEN f IN ('apache', 'nginx') THEN strptime(split_part({_g(_ACCESS, 2)}, ' ', 1), '%d/%b/%Y:%H:%M:%S')
  WHEN f = 'syslog' THEN strptime('2024 ' || {_g(_SYSLOG, 1)}, '%Y %b %d %H:%M:%S')
  WHEN f = 'application' THEN strptime({_g(_APP, 1)}, '%Y-%m-%d %H:%M:%S')
  WHEN f = 'json' THEN strptime(json_extract_string(t, '$.timestamp'), '%Y-%m-%dT%H:%M:%SZ')
  ELSE TIMESTAMP '{INGEST}' END AS ts_wall,
 CASE WHEN f = 'application' THEN {_g(_APP, 2)} WHEN f = 'json' THEN upper(json_extract_string(t, '$.level'))
  ELSE 'INFO' END AS level,
 CASE WHEN f IN ('apache', 'nginx') THEN f WHEN f = 'syslog' THEN {_g(_SYSLOG, 2)}
  WHEN f = 'application' THEN nullif({_g(_APP, 4)}, '') WHEN f = 'json' THEN json_extract_string(t, '$.service')
  ELSE 'unknown' END AS source,
 CASE WHEN f IN ('apache', 'nginx') THEN {_g(_ACCESS, 3)} || ' ' || {_g(_ACCESS, 4)} || ' ' || {_g(_ACCESS, 5)}
   || ' - ' || {_g(_ACCESS, 6)}
  WHEN f = 'syslog' THEN {_g(_SYSLOG, 4)} WHEN f = 'application' THEN {_g(_APP, 5)}
  WHEN f = 'json' THEN json_extract_string(t, '$.message') ELSE t END AS message,
 CASE WHEN f = 'apache' THEN {_quoted(apache)} WHEN f = 'nginx' THEN {_quoted(nginx)}
  WHEN f = 'syslog' THEN {_quoted([("hostname", _g(_SYSLOG, 2), 1), ("process", _g(_SYSLOG, 3), 1)])}
  WHEN f = 'application' THEN '{{"thread":' || {null_or.format(_g(_APP, 3))} || ',"logger":' || {null_or.format(_g(_APP, 4))} || '}}'
  WHEN f = 'json' THEN t ELSE '{{}}' END AS metadata
 FROM shaped WHERE f IS NULL OR f <> 'json' OR json_valid(t))"""


_OUT = f"event_id, {wall('ts_wall')} AS ts_wall, level, source, message, metadata, format"


def _format_sql(name: str) -> str:
    return f"WITH {_parsed_sql()} SELECT {_OUT} FROM parsed WHERE format = '{name}'"


_COMBINED_LINES = """log_lines2 AS (SELECT event_id, file, line_no, CASE WHEN contains(line, 'HTTP/1.1')
 THEN line || ' "https://ref.example/' || CAST(event_id AS VARCHAR) || '" "Agent/1.0 (x)"' ELSE line END AS line
 FROM log_lines)"""


def _combined_sql() -> str:
    return _parsed_sql(True, "log_lines2").replace("stripped AS", _COMBINED_LINES + ", stripped AS", 1)


def _timestamps_sql() -> str:
    second = "date_trunc('second', ts)"
    rows = [
        ("dashed", second, second),
        ("point", "ts", "ts"),
        ("comma", "date_trunc('millisecond', ts)", "date_trunc('millisecond', ts)"),
        ("access", second, f"{second} - INTERVAL '5 hours 30 minutes'"),
        ("syslog", f"{second} - to_years(CAST(year(ts) - 2024 AS INT))", f"{second} - to_years(CAST(year(ts) - 2024 AS INT))"),
        ("zulu", second, second),
        ("zulu_point", "ts", "ts"),
        ("offset", second, f"{second} + INTERVAL '2 hours'"),
        ("named", second, second),
        ("unreadable", "CAST(NULL AS TIMESTAMP)", "CAST(NULL AS TIMESTAMP)"),
    ]
    return " UNION ALL ".join(
        f"SELECT event_id, '{shape}' AS shape, {wall(w)} AS ts_wall, epoch_us({t}) AS ts_micros FROM events"
        for shape, w, t in rows
    )


ORACLES = {
    "detect_format": f"WITH {LINES}, s AS (SELECT event_id, trim(line) AS t FROM log_lines WHERE trim(line) <> '') "
    f"SELECT event_id, {_format_case(False)} AS format FROM s",
    "parse_timestamp": _timestamps_sql(),
    "parse_json_lines": _format_sql("json"),
    "parse_access_lines": _format_sql("apache"),
    "parse_syslog_lines": _format_sql("syslog"),
    "parse_application_lines": _format_sql("application"),
    "parse_generic_lines": _format_sql("generic"),
    "parse_logs": f"WITH {_parsed_sql()} SELECT {_OUT} FROM parsed",
    "parse_rejects": f"WITH {LINES} SELECT event_id, line AS raw_log, 'malformed_json' AS reason FROM log_lines "
    "WHERE regexp_matches(trim(line), '^\\{.*\\}$') AND NOT json_valid(trim(line))",
    "parse_combined_access": f"WITH {_combined_sql()} SELECT {_OUT} FROM parsed WHERE format = 'nginx'",
    "request_fields": f"WITH {_combined_sql()} SELECT event_id, CASE WHEN format = 'nginx' THEN {_g(_COMBINED, 1)} END AS source_ip, "
    f"CASE WHEN format = 'nginx' THEN {_g(_COMBINED, 9)} END AS user_agent, "
    f"CASE WHEN format = 'nginx' THEN {_g(_COMBINED, 4)} END AS request_path, "
    f"CASE WHEN format = 'nginx' THEN CAST({_g(_COMBINED, 6)} AS INT) END AS response_code FROM parsed",
    "message_after_bracket": f"WITH {LINES} SELECT event_id, CASE WHEN contains(line, '] ') "
    "THEN substr(line, instr(line, '] ') + 2) ELSE line END AS message FROM log_lines",
    "nonblank_filter": f"WITH {LINES} SELECT event_id, line FROM log_lines WHERE regexp_matches(line, '\\S')",
    "entry_table_export": f"WITH {_parsed_sql()} SELECT {wall('ts_wall')} AS timestamp, level, source, message, raw_log, metadata FROM parsed",
    "level_by_source_hour": f"WITH {_parsed_sql()} SELECT source, hour(ts_wall) AS hour, count(*) AS lines, "
    "round(avg(CASE WHEN level IN ('ERROR', 'CRITICAL', 'FATAL') THEN 1 ELSE 0 END), 6) AS error_ratio FROM parsed GROUP BY 1, 2",
}
