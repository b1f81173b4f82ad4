"""Log tables derived from the ``events`` table, for the registered queries and the benchmark.

The given tables hold no log lines, so every event is rendered as one: as a typed entry (``log_entries``), as a
raw line in one of five shapes plus blank and malformed ones (``log_lines``), and as a scored entry (``scored``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

ENTRY_SQL = """
SELECT event_id, ts,
 CASE event_type WHEN 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'CRITICAL' ELSE 'ERROR' END
   WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'WARN' ELSE 'WARNING' END
   WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
 CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'svc_' || CAST(user_id % 5 AS STRING) END AS source,
 CASE event_type
   WHEN 'error' THEN 'Gate refused a failed login by host 10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 250 AS STRING) || ', wrong password'
   WHEN 'purchase' THEN 'Report built by SELECT total FROM t' || CAST(user_id % 7 AS STRING) || ' in ' || CAST(CAST(floor(value) AS INT) AS STRING) || 'ms'
   WHEN 'signup' THEN 'Receipt mailed to user' || CAST(user_id AS STRING) || '@example.com'
   WHEN 'view' THEN 'Page /shop/items/' || CAST(user_id AS STRING) || ' shown with code 200'
   ELSE 'Session opened for user_' || CAST(user_id AS STRING) || ' at the desk' END AS message,
 'f' || CAST(event_id % 8 AS STRING) AS file, event_id AS line_no,
 event_type = 'error' AS is_anomaly, round(1 - exp(-value / 50), 6) AS score
FROM {events}
"""

LINE_SQL = """
SELECT event_id, file, line_no, CASE
 WHEN event_id % 50 = 4 THEN '   '
 WHEN event_id % 50 = 1 THEN '{{"timestamp": broken}}'
 WHEN event_id % 5 = 0 THEN {iso} || ' [' || level || '] [t' || CAST(event_id % 3 AS STRING) || '] auth - ' || message
 WHEN event_id % 5 = 1 THEN '{{"timestamp":"' || {isoz} || '","level":"' || lower(level) || '","service":"' || coalesce(source, 'none') || '","message":"' || message || '"}}'
 WHEN event_id % 5 = 2 THEN '10.0.0.' || CAST(event_id % 250 AS STRING) || ' - - [' || {clf} || ' +0000] "GET /p/' || CAST(event_id % 9 AS STRING) || ' HTTP/1.1" ' || CASE WHEN is_anomaly THEN '401' ELSE '200' END || ' ' || CAST(event_id AS STRING)
 WHEN event_id % 5 = 3 THEN {syslog} || ' web' || CAST(event_id % 4 AS STRING) || ' sshd[' || CAST(event_id AS STRING) || ']: ' || message
 ELSE 'note: ' || message END AS line
FROM {entries}
"""

SPARK_TIMES = {
    "iso": "date_format(ts,'yyyy-MM-dd HH:mm:ss')",
    "isoz": "date_format(ts,\"yyyy-MM-dd'T'HH:mm:ss'Z'\")",
    "clf": "date_format(ts,'dd/MMM/yyyy:HH:mm:ss')",
    "syslog": "date_format(ts,'MMM dd HH:mm:ss')",
}
DUCKDB_TIMES = {
    "iso": "strftime(ts,'%Y-%m-%d %H:%M:%S')",
    "isoz": "strftime(ts,'%Y-%m-%dT%H:%M:%SZ')",
    "clf": "strftime(ts,'%d/%b/%Y:%H:%M:%S')",
    "syslog": "strftime(ts,'%b %d %H:%M:%S')",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries_of(events: DataFrame) -> DataFrame:
    return events.sparkSession.sql(ENTRY_SQL.format(events="{events}"), events=events)


def lines_of(entries: DataFrame) -> DataFrame:
    # braces of the JSON shapes stay doubled for the session's own formatting pass
    query = LINE_SQL
    for name, expression in {**SPARK_TIMES, "entries": "{{entries}}"}.items():
        query = query.replace("{" + name + "}", expression.replace("{{", "{").replace("}}", "}"))
    return entries.sparkSession.sql(query, entries=entries)


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed entries: ``ts`` as an instant, ``ts_wall`` as the clock reading."""
    return (
        entries_of(table(spark, sf_dir, "events"))
        .withColumn("ts_wall", F.col("ts").cast("timestamp_ntz"))
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines with their position."""
    return lines_of(entries_of(table(spark, sf_dir, "events")))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_entries(spark, sf_dir).select(
        "*",
        F.col("score").alias("anomaly_score"),
        (F.col("score") > 0.7).cast("int").alias("prediction"),
        F.col("is_anomaly").cast("int").alias("label"),
    )
