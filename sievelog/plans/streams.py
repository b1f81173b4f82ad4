"""Registered queries: streams, files and sinks. What they write goes to the shared folder and is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievelog.operators import evaluate as ev
from sievelog.operators import scoring
from sievelog.operators.alerts import create_alerts, match_rules
from sievelog.operators.ordered import whole_division
from sievelog.operators.parse import parse_logs
from sievelog.plans import alerting, detection, parsing, traffic
from sievelog.plans.views import entries_of, lines_of, log_entries, log_lines, scored, table
from sievelog.plans.views_sql import ENTRIES, SCORED
from sievelog.session import scratch_path
from sievelog.sources import readers, writers
from sievelog.streaming import streams as st


def _event_stream(spark, sf_dir) -> DataFrame:
    return readers.stream_table(spark, sf_dir, "events", table(spark, sf_dir, "events").schema)


def _entry_stream(spark, sf_dir) -> DataFrame:
    return entries_of(_event_stream(spark, sf_dir)).withColumn("ts", F.col("ts").cast("timestamp"))


def _line_stream(spark, sf_dir) -> DataFrame:
    return lines_of(entries_of(_event_stream(spark, sf_dir)))


def _ingest():
    return F.lit(parsing.INGEST).cast("timestamp")


def stream_parse(spark, sf_dir):
    """The log as a stream through the batch parser."""
    parsed = parse_logs(_line_stream(spark, sf_dir), "line", ingest_ts=_ingest(), default_year=2024)
    kept = parsed.select("event_id", "ts_wall", "level", "source", "message", "metadata", "format")
    out = st.run_to_table(kept, "stream-parse")
    return out.withColumn("ts_wall", parsing.wall_text("ts_wall"))


def _matched_stream(spark, sf_dir) -> DataFrame:
    entries = _entry_stream(spark, sf_dir).drop("is_anomaly")
    detected = scoring.detect(entries, "score", alerting.THRESHOLD)
    return match_rules(create_alerts(detected, keep=("line_no",)), alerting.config())


def stream_cooldown(spark, sf_dir):
    return st.run_to_table(st.stream_cooldown(_matched_stream(spark, sf_dir)), "stream-cooldown").select("line_no", "id")


def stream_cooldown_keyed(spark, sf_dir):
    """The same with a value of its own for each identity."""
    sent = st.stream_cooldown_keyed(_matched_stream(spark, sf_dir))
    return st.run_to_table(sent, "stream-cooldown-keyed").select("line_no", "id")


def stream_counts(spark, sf_dir):
    entries = _entry_stream(spark, sf_dir).drop("is_anomaly")
    detected = scoring.detect(entries, "score", traffic.THRESHOLD)
    return st.run_to_table(st.severity_counters(detected), "stream-counts", "complete")


def stream_sliding_window(spark, sf_dir):
    counts = st.sliding_counts(_entry_stream(spark, sf_dir), ["source"], watermark="1 minute")
    out = st.run_to_table(counts, "stream-sliding", "complete")
    return out.select(
        traffic._text("window_start"), "source", "lines", F.round("error_ratio", 6).alias("error_ratio"), "anomalies"
    )


PARTS = 4


def _in_order_of_time(spark, sf_dir, held_back=None):
    """The entries in four parts that follow each other in time: ``(folder, schema, write part k)``.

    Each part is written as files of the folder when asked, so a query started after it has one trigger for it. Rows
    for which ``held_back`` holds come with the part after their own.
    """
    path = scratch_path(spark, "entries")
    entries = log_entries(spark, sf_dir).select("line_no", "message", "source", "level", "is_anomaly", "ts")
    us = F.unix_micros("ts")
    first, last = entries.select(F.min(us), F.max(us)).head()
    span = (0 if first is None else last - first) + 1
    part = whole_division((us - F.lit(first or 0)) * PARTS, span)
    if held_back is not None:
        part = F.least(part + F.coalesce(held_back, F.lit(False)).cast("bigint"), F.lit(PARTS - 1))
    return path, entries.schema, lambda k: entries.where(part == k).write.mode("append").parquet(path)


def stream_dedup_24h(spark, sf_dir):
    """Messages as they would be scored anew: none kept in the 24 hours before, over several triggers and restarts."""
    path, kinds, write = _in_order_of_time(spark, sf_dir)
    out, checkpoint = scratch_path(spark, "dedup"), scratch_path(spark, "dedup-checkpoint")
    for k in range(PARTS):
        write(k)
        stream = spark.readStream.schema(kinds).parquet(path).select("line_no", "message", "ts")
        st.start_dedup(stream, out, checkpoint, availableNow=True).awaitTermination()
    return spark.read.parquet(out).select("line_no", "msg_md5")


def stream_closed_windows(spark, sf_dir):
    """Sliding windows in append mode: those the watermark has closed, over several triggers and restarts."""
    path, kinds, write = _in_order_of_time(spark, sf_dir)
    out, checkpoint = scratch_path(spark, "closed"), scratch_path(spark, "closed-checkpoint")
    for k in range(PARTS):
        write(k)
        counts = st.sliding_counts(spark.readStream.schema(kinds).parquet(path), ["source"], watermark="1 minute")
        writer = counts.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.format("parquet").outputMode("append").start(out).awaitTermination()
    return _windows(spark.read.schema(counts.schema).parquet(out))


def _windows(counts: DataFrame) -> DataFrame:
    return counts.select(
        traffic._text("window_start"), "source", "lines", F.round("error_ratio", 6).alias("error_ratio"), "anomalies"
    )


def stream_late_rows(spark, sf_dir):
    """Closed windows and the rows that came too late: one row in fifty arrives with the part after its own."""
    path, kinds, write = _in_order_of_time(spark, sf_dir, F.col("line_no") % 50 == 7)
    out, checkpoint = scratch_path(spark, "windows"), scratch_path(spark, "windows-checkpoint")
    for k in range(PARTS):
        write(k)
        stream = spark.readStream.schema(kinds).parquet(path)
        st.start_windows(stream, ["source"], out, checkpoint, availableNow=True).awaitTermination()
    windows = _windows(spark.read.parquet(out)).withColumns({"line_no": F.lit(None).cast("long"), "late_windows": F.lit(None).cast("long")})
    late = spark.read.parquet(f"{out}-late").select("line_no", "late_windows")
    return windows.unionByName(late, allowMissingColumns=True)


def stream_monitor(spark, sf_dir):
    """The monitor's counters, gathered from a running query trigger by trigger."""
    path, kinds, write = _in_order_of_time(spark, sf_dir)
    monitor, checkpoint = st.LiveMonitor(), scratch_path(spark, "monitor-checkpoint")
    spark.streams.addListener(monitor)
    try:
        for k in range(PARTS):
            write(k)
            stream = spark.readStream.schema(kinds).parquet(path)
            watched = monitor.watch(stream, errors=F.col("source").isNull())
            query = watched.writeStream.format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
            monitor.ended.wait(60)
    finally:
        spark.streams.removeListener(monitor)
    out = spark.createDataFrame([monitor.stats()], "lines_processed long, anomalies_detected long, errors long, elapsed_seconds double, lines_per_second double, anomaly_rate double")
    return out.withColumns({c: F.round(c, 6) for c in ("lines_per_second", "anomaly_rate")})


def _hashed_score():
    return F.conv(F.substring(F.md5("message"), 1, 4), 16, 10).cast("double") / 65535


def stream_end_to_end(spark, sf_dir):
    """Lines to outbox in one query, then the outbox."""
    detected = st.detect_stream(
        _line_stream(spark, sf_dir).withColumnRenamed("line", "value"),
        _hashed_score(),
        threshold=alerting.THRESHOLD,
        ingest_ts=_ingest(),
        default_year=2024,
    )
    outbox, checkpoint = scratch_path(spark, "outbox"), scratch_path(spark, "outbox-checkpoint")
    query = st.start_alerting(detected, alerting.config(), outbox, checkpoint, availableNow=True)
    query.awaitTermination()
    out = writers.read_outbox(spark, outbox)
    return out.select("alert_id", "channel", alerting.time_text(), "payload")


def _log_files(spark, sf_dir) -> str:
    path = scratch_path(spark, "lines")
    log_lines(spark, sf_dir).select(F.col("line").alias("value")).write.text(path)
    return path


def scan_text(spark, sf_dir):
    """The log written as text files and scanned back."""
    entries = readers.read_logs(spark, _log_files(spark, sf_dir), ingest_ts=_ingest(), default_year=2024)
    return entries.select(
        parsing.wall_text("ts_wall").alias("ts_wall"), "level", "source", "message", "raw_log", "format"
    )


def tail_appends(spark, sf_dir):
    """Log files that grow three times, followed by a query that is started anew each time."""
    folder, out, checkpoint = (scratch_path(spark, f"tail-{x}") for x in ("logs", "out", "checkpoint"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = F.concat_ws("-", "file", F.pmod(F.xxhash64("line_no"), F.lit(parts)))
    lines = log_lines(spark, sf_dir).select(name.alias("name"), (F.col("line_no") % 3).alias("portion"), "line_no", "line")
    for portion in range(3):
        writers.write_log_files(lines.where(F.col("portion") <= portion), folder, "name", ["portion", "line_no"])
        followed = readers.follow_files(spark, folder).select("value")
        parsed = parse_logs(followed, "value", ingest_ts=_ingest(), default_year=2024)
        rows = parsed.select("ts_wall", "level", "source", "message", "raw_log", "format")
        writer = rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        writer.format("parquet").start(out).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).withColumn("ts_wall", parsing.wall_text("ts_wall"))


def scan_unlabelled(spark, sf_dir):
    rows = readers.read_unlabelled(spark, _log_files(spark, sf_dir), ingest_ts=_ingest())
    return rows.select("message", "is_anomaly")


def _labelled(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id",
        F.col("text").alias("message"),
        F.concat_ws(" ", "source", "text").alias("raw_log"),
        (F.col("toxic") == 1).alias("is_anomaly"),
        F.lit("2024-01-15T10:00:00Z").alias("timestamp"),
    )


ARRAY_ROWS = 500


def scan_json(spark, sf_dir):
    """Labelled samples as JSON arrays of bounded length, one per file, scanned back."""
    path = scratch_path(spark, "labelled-json")
    part = F.floor(F.col("doc_id") / ARRAY_ROWS).alias("part")
    arrays = (
        _labelled(spark, sf_dir)
        .groupBy(part)
        .agg(F.to_json(F.collect_list(F.struct("message", "raw_log", "is_anomaly", "timestamp"))).alias("value"))
    )
    arrays.repartition("part").write.partitionBy("part").text(path)
    return readers.read_labelled_json(spark, path).select("message", "raw_log", "is_anomaly", "timestamp")


def scan_csv(spark, sf_dir):
    path = scratch_path(spark, "labelled-csv")
    writers.write_csv(_labelled(spark, sf_dir).select("message", "is_anomaly"), path)
    return readers.read_labelled_csv(spark, path).select("message", "is_anomaly")


def scan_csv_without_labels(spark, sf_dir):
    path = scratch_path(spark, "unlabelled-csv")
    writers.write_csv(_labelled(spark, sf_dir).select("message"), path)
    return readers.read_labelled_csv(spark, path).select("message", "is_anomaly")


def write_json(spark, sf_dir):
    path = scratch_path(spark, "dataset-json")
    df = _labelled(spark, sf_dir)
    writers.write_json(df, path)
    return spark.read.schema(df.schema).json(path)


def write_csv(spark, sf_dir):
    path = scratch_path(spark, "dataset-csv")
    df = _labelled(spark, sf_dir)
    writers.write_csv(df, path)
    return spark.read.schema(df.schema).csv(path, header=True, multiLine=True, escape='"')


def write_metrics(spark, sf_dir):
    """The whole metrics report, written and read back: a row per section, row of it and number."""
    path = scratch_path(spark, "metrics")
    writers.write_metrics(ev.full_report(scored(spark, sf_dir)), path)
    rows = spark.read.schema("section string, row string").json(path)
    values = rows.select("section", F.from_json("row", "map<string,string>").alias("v"))
    item = F.coalesce(F.col("v")["class"], F.col("v")["label"], F.lit(""))
    named = values.select("section", item.alias("item"), F.explode(F.map_filter("v", lambda k, _: ~k.isin("class", "label"))).alias("name", "value"))
    return named.withColumn("value", F.round(F.col("value").cast("double"), 6))


QUERIES = {
    "stream_parse": stream_parse,
    "stream_cooldown": stream_cooldown,
    "stream_cooldown_keyed": stream_cooldown_keyed,
    "stream_counts": stream_counts,
    "stream_sliding_window": stream_sliding_window,
    "stream_dedup_24h": stream_dedup_24h,
    "stream_closed_windows": stream_closed_windows,
    "stream_late_rows": stream_late_rows,
    "stream_monitor": stream_monitor,
    "stream_end_to_end": stream_end_to_end,
    "tail_appends": tail_appends,
    "scan_text": scan_text,
    "scan_unlabelled": scan_unlabelled,
    "scan_json": scan_json,
    "scan_csv": scan_csv,
    "scan_csv_without_labels": scan_csv_without_labels,
    "write_json": write_json,
    "write_csv": write_csv,
    "write_metrics": write_metrics,
}

_LABELLED = (
    "labelled AS (SELECT d.doc_id, text AS message, source || ' ' || text AS raw_log, toxic = 1 AS is_anomaly, "
    "'2024-01-15T10:00:00Z' AS timestamp FROM documents d LEFT JOIN labels l USING (doc_id))"
)
_LABEL = "coalesce(is_anomaly, false) AS is_anomaly"
_PAIRS = """e AS (SELECT line_no, source, coalesce(level = 'ERROR', false) AS error, is_anomaly, epoch_us(ts) AS us FROM log_entries),
 p AS (SELECT *, least({parts} - 1, (us - (SELECT min(us) FROM e)) * {parts} // ((SELECT max(us) - min(us) FROM e) + 1) + CAST({held} AS INT)) AS part FROM e),
 n AS (SELECT part, max(max(us)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 60000000 AS mark FROM p GROUP BY part),
 pairs AS (SELECT p.*, mark, (us // 10000000 - j) * 10000000 AS start FROM p JOIN n USING (part), range(6) AS r(j)),
 judged AS (SELECT *, coalesce(start + 60000000 <= mark, false) AS late FROM pairs),
 windows AS (SELECT start, source, count(*) AS lines, round(avg(CAST(error AS INT)), 6) AS error_ratio, count(*) FILTER (is_anomaly) AS anomalies
 FROM judged WHERE NOT late AND start + 60000000 <= (SELECT max(us) FROM e) - 60000000 GROUP BY ALL)"""
_START = "strftime(make_timestamp(start), '%Y-%m-%d %H:%M:%S.%f') AS window_start"
_E2E = f"""WITH RECURSIVE {parsing._parsed_sql()}, scored AS (SELECT event_id AS line_no, message, source, ts_wall AS ts,
 CAST('0x' || substr(md5(message), 1, 4) AS INT) / 65535.0::DOUBLE AS score FROM parsed)"""
_ALERTS_OF_SCORED = alerting.ALERTS[len(SCORED) :]

_SECTIONS = {
    "binary_metrics": ("binary_metrics", "''", "num_samples num_anomalies accuracy precision recall f1"),
    "areas": ("roc_auc", "''", "roc_auc"),
    "areas ": ("average_precision", "''", "average_precision"),
    "class_report": ("class_report", "class", "precision recall f1 support"),
    "confusion_matrix": ("confusion_matrix", "CAST(label AS VARCHAR)", "pred_0 pred_1"),
    "label_agreement": ("label_agreement", "''", "total correct agreement"),
}
_METRICS_SQL = " UNION ALL ".join(
    f"SELECT '{section.strip()}' AS section, {item} AS item, '{name}' AS name, CAST({name} AS DOUBLE) AS value FROM ({detection.ORACLES[query]})"
    for section, (query, item, names) in _SECTIONS.items()
    for name in names.split()
)

ORACLES = {
    "stream_parse": parsing.ORACLES["parse_logs"],
    "stream_cooldown": alerting.ORACLES["cooldown"],
    "stream_cooldown_keyed": alerting.ORACLES["cooldown"],
    "stream_counts": traffic.ORACLES["severity_counts"],
    "stream_sliding_window": traffic.ORACLES["sliding_window_60_10"],
    "stream_dedup_24h": f"WITH RECURSIVE {SCORED}, {alerting._walk_sql('scored', 'md5(message)', '86400')} "
    "SELECT line_no, k AS msg_md5 FROM walk WHERE sent",
    # in order of time no row is late; the native watermark counts in milliseconds, which none of these windows' ends tells apart
    "stream_closed_windows": f"WITH {ENTRIES}, {_PAIRS.format(parts=PARTS, held='false')} SELECT {_START}, source, lines, error_ratio, anomalies FROM windows",
    "stream_late_rows": f"WITH {ENTRIES}, {_PAIRS.format(parts=PARTS, held='line_no % 50 = 7')} SELECT {_START}, source, lines, error_ratio, anomalies, "
    "CAST(NULL AS BIGINT) AS line_no, CAST(NULL AS BIGINT) AS late_windows FROM windows UNION ALL "
    "SELECT NULL, NULL, NULL, NULL, NULL, line_no, count(*) FROM judged WHERE late GROUP BY line_no",
    "stream_monitor": traffic.ORACLES["monitor_stats"].replace("score > 0.7", "is_anomaly"),
    "stream_end_to_end": _E2E
    + _ALERTS_OF_SCORED
    + alerting.ORACLES["alert_payload"][len("WITH RECURSIVE " + alerting.ALERTS) :],
    "scan_text": f"WITH {parsing._parsed_sql()} SELECT {parsing.wall('ts_wall')} AS ts_wall, level, source, message, raw_log, format FROM parsed",
    "tail_appends": f"WITH {parsing._parsed_sql()} SELECT {parsing.wall('ts_wall')} AS ts_wall, level, source, message, raw_log, format FROM parsed",
    "scan_unlabelled": f"WITH {parsing._parsed_sql()} SELECT message, false AS is_anomaly FROM parsed",
    "scan_json": f"WITH {_LABELLED} SELECT message, raw_log, {_LABEL}, timestamp FROM labelled",
    "scan_csv": f"WITH {_LABELLED} SELECT message, {_LABEL} FROM labelled",
    "scan_csv_without_labels": "SELECT text AS message, false AS is_anomaly FROM documents",
    "write_json": f"WITH {_LABELLED} SELECT * FROM labelled",
    "write_csv": f"WITH {_LABELLED} SELECT * FROM labelled",
    "write_metrics": _METRICS_SQL,
}
