"""Registered queries: counters, profiles, attack patterns, order and sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievelog.operators import profile as pr
from sievelog.operators import scoring
from sievelog.plans.views import scored, table
from sievelog.plans.views_sql import SCORED
from sievelog.streaming.streams import sliding_counts

THRESHOLD = 0.7
INJECTION = r"(?i)\bselect \* from\b"


def detected(spark, sf_dir) -> DataFrame:
    entries = scored(spark, sf_dir).drop("is_anomaly", "anomaly_score")
    return scoring.detect(entries, "score", THRESHOLD)


def _text(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(column)


def severity_counts(spark, sf_dir):
    return pr.severity_counts(detected(spark, sf_dir))


def run_totals(spark, sf_dir):
    return pr.run_totals(detected(spark, sf_dir)).withColumn("last_alert", _text("last_alert"))


def monitor_stats(spark, sf_dir):
    out = pr.monitor_stats(detected(spark, sf_dir), errors=F.col("source").isNull())
    return out.withColumns({c: F.round(c, 6) for c in ("lines_per_second", "anomaly_rate")})


def hourly_profile(spark, sf_dir):
    out = pr.hourly_profile(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), 10)
    return out.select(_text("hour_start"), "lines", "expected", F.round("ratio", 6).alias("ratio"))


def _logins(spark, sf_dir) -> DataFrame:
    """Authentication events: an error is a failed login of the user, a click a successful one."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("actor"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "error").alias("failed"),
        (F.col("event_type") == "click").alias("succeeded"),
    )


def failure_bursts(spark, sf_dir):
    out = pr.failure_bursts(_logins(spark, sf_dir), "actor", F.col("failed"), 2, "12 hours")
    return out.select("actor", _text("window_start"), "failures")


def bruteforce_burst(spark, sf_dir):
    out = pr.success_after_failures(
        _logins(spark, sf_dir), "actor", F.col("failed"), F.col("succeeded"), 5, rows_per_cell=2000
    )
    return out.select("actor", _text("ts"), "failures_before", "successes")


def injection_session(spark, sf_dir):
    hits = scored(spark, sf_dir).where(F.col("message").rlike(INJECTION))
    out = pr.activity_sessions(hits, "source", 1800, 2, rows_per_cell=500)
    return out.select("source", _text("session_start"), _text("session_end"), "events")


def sort_by_time(spark, sf_dir):
    return pr.sort_by_time(scored(spark, sf_dir)).select("line_no", _text("ts"), "message")


def first_n(spark, sf_dir):
    return pr.first_rows(scored(spark, sf_dir), 100, ["ts", "line_no"]).select("line_no", "message")


def sliding_window(spark, sf_dir):
    out = sliding_counts(scored(spark, sf_dir), ["source"])
    return out.select(
        _text("window_start"), "source", "lines", F.round("error_ratio", 6).alias("error_ratio"), "anomalies"
    )


QUERIES = {
    "severity_counts": severity_counts,
    "run_totals": run_totals,
    "monitor_stats": monitor_stats,
    "hourly_profile": hourly_profile,
    "failure_bursts": failure_bursts,
    "bruteforce_burst": bruteforce_burst,
    "injection_session": injection_session,
    "sort_by_time": sort_by_time,
    "first_n": first_n,
    "sliding_window_60_10": sliding_window,
}

_W = f"WITH {SCORED}"
_FMT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_SEV = "CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END"
_LOGINS = "WITH logins AS (SELECT 'user_' || CAST(user_id AS VARCHAR) AS actor, ts, event_type = 'error' AS failed, event_type = 'click' AS succeeded FROM events)"

ORACLES = {
    "severity_counts": f"{_W} SELECT {_SEV} AS severity, count(*) AS anomalies FROM scored WHERE score > 0.7 GROUP BY 1",
    "run_totals": f"{_W} SELECT count(*) AS total_requests, count(*) FILTER (score > 0.7) AS anomalies_detected, "
    f"{_FMT.format('max(ts) FILTER (score > 0.7)')} AS last_alert FROM scored",
    "monitor_stats": f"{_W}, c AS (SELECT count(*) AS n, count(*) FILTER (score > 0.7) AS a, count(*) FILTER (source IS NULL) AS e, "
    "(max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS s FROM scored) SELECT n AS lines_processed, a AS anomalies_detected, e AS errors, s AS elapsed_seconds, "
    "round(n / s, 6) AS lines_per_second, round(a * 1.0::DOUBLE / greatest(n, 1), 6) AS anomaly_rate FROM c",
    "hourly_profile": "WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) AS lines FROM events GROUP BY 1), "
    "x AS (SELECT *, CASE WHEN hour(h) BETWEEN 9 AND 17 THEN 15.0::DOUBLE WHEN hour(h) >= 22 OR hour(h) <= 6 THEN 3.0::DOUBLE ELSE 10.0::DOUBLE END AS expected FROM h) "
    f"SELECT {_FMT.format('h')} AS hour_start, lines, expected, round(lines / expected, 6) AS ratio FROM x",
    "failure_bursts": f"{_LOGINS} SELECT actor, {_FMT.format('w')} AS window_start, count(*) AS failures FROM "
    "(SELECT actor, make_timestamp(epoch_us(ts) // 43200000000 * 43200000000) AS w FROM logins WHERE failed) GROUP BY actor, w HAVING count(*) >= 2",
    "bruteforce_burst": f"{_LOGINS}, m AS (SELECT actor, ts, count(*) FILTER (failed) AS f, count(*) FILTER (succeeded) AS s FROM logins WHERE failed OR succeeded GROUP BY ALL), "
    "b AS (SELECT *, sum(f) OVER (PARTITION BY actor ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m) "
    f"SELECT actor, {_FMT.format('ts')} AS ts, CAST(before AS BIGINT) AS failures_before, s AS successes FROM b WHERE s > 0 AND before >= 5",
    "injection_session": f"{_W}, h AS (SELECT * FROM scored WHERE source IS NOT NULL AND regexp_matches(message, '(?i)\\bselect \\* from\\b')), "
    "o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1800 SECONDS THEN 0 ELSE 1 END AS opens FROM h WINDOW w AS (PARTITION BY source ORDER BY ts)), "
    "n AS (SELECT *, sum(opens) OVER (PARTITION BY source ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM o) "
    f"SELECT source, {_FMT.format('min(ts)')} AS session_start, {_FMT.format('max(ts)')} AS session_end, count(*) AS events FROM n GROUP BY source, s HAVING count(*) >= 2",
    "sort_by_time": f"{_W} SELECT line_no, {_FMT.format('ts')} AS ts, message FROM scored ORDER BY scored.ts, line_no",
    "first_n": f"{_W} SELECT line_no, message FROM scored ORDER BY ts, line_no LIMIT 100",
    "sliding_window_60_10": f"{_W}, w AS (SELECT *, unnest([0, 1, 2, 3, 4, 5]) AS k FROM scored), "
    "x AS (SELECT *, make_timestamp((epoch_us(ts) // 10000000 - k) * 10000000) AS window_start FROM w) "
    f"SELECT {_FMT.format('window_start')} AS window_start, source, count(*) AS lines, round(avg(CASE WHEN level = 'ERROR' THEN 1.0::DOUBLE ELSE 0 END), 6) AS error_ratio, "
    "count(*) FILTER (is_anomaly) AS anomalies FROM x GROUP BY x.window_start, source",
}
