import datetime as dt
import random

from pyspark.sql import functions as F

from sievelog.operators.alerts import read_config
from sievelog.operators.cooldown import apply_cooldown
from sievelog.operators.parse import parse_logs
from sievelog.sources.readers import stream_lines
from sievelog.sources.writers import read_outbox
from sievelog.streaming import streams as st

START = dt.datetime(2024, 3, 1, 8)
SETTINGS = {
    "alerting": {
        "channels": {"slack": {"webhook_url": "https://s"}},
        "rules": {"hi": {"threshold": 0.9, "cooldown": 20, "channels": ["slack"]},
                  "lo": {"threshold": 0.5, "cooldown": 60, "channels": ["slack"]}},
    }
}


def _batches(spark, folder, parts, schema):
    """A file stream that delivers one part per trigger, in order."""
    import os
    import time

    folder = str(folder)
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and os.path.getmtime(path) > 1_000_000_000:
                os.utime(path, (100_000 + i, 100_000 + i))
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _alert_rows(seed, n=200):
    rnd = random.Random(seed)
    rows, at = [], 0
    for i in range(n):
        at += rnd.randint(0, 12)
        rows.append((rnd.choice("abc"), i, START + dt.timedelta(seconds=at), rnd.choice([20, 60]), True))
    return rows


ALERTS = "id string, line_no bigint, ts timestamp, cooldown int, deliverable boolean"


def test_cooldown_over_many_triggers_equals_batch(spark, tmp_path):
    rows = _alert_rows(1)
    stream = _batches(spark, tmp_path / "in", [rows[i : i + 50] for i in range(0, 200, 50)], ALERTS)
    sent = st.run_to_table(st.stream_cooldown(stream, buckets=2), "cooldown-test")
    batch = apply_cooldown(spark.createDataFrame(rows, ALERTS))
    assert sorted(r["line_no"] for r in sent.collect()) == sorted(r["line_no"] for r in batch.collect())


DETECTED = "line_no bigint, ts timestamp, message string, source string, anomaly_score double, is_anomaly boolean"


def test_alert_stream_over_many_triggers_equals_batch(spark, tmp_path):
    rnd = random.Random(2)
    rows, at = [], 0
    for i in range(120):
        at += rnd.randint(0, 12)
        score = rnd.choice([0.3, 0.6, 0.95])
        rows.append((i, START + dt.timedelta(seconds=at), rnd.choice(["m1", "m2"]), "s", score, score > 0.5))
    config = read_config(SETTINGS, {})
    stream = _batches(spark, tmp_path / "in", [rows[i : i + 40] for i in range(0, 120, 40)], DETECTED)
    outbox = str(tmp_path / "outbox")
    query = st.start_alerting(stream, config, outbox, str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination()
    found = read_outbox(spark, outbox)
    whole = spark.createDataFrame(rows, DETECTED)
    sent = apply_cooldown(st.alert_stream(whole, config).where("deliverable"))
    assert found.count() == sent.count() > 3
    assert sorted(r["ts"] for r in found.collect()) == sorted(r["ts"] for r in sent.collect())


def test_followed_folder_parses_like_a_batch(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text("2024-01-01 10:00:00 [INFO] a b\n\nfree text\n")
    (folder / "b.log").write_text('{"level":"warn","message":"m"}\n{broken}\n')
    parsed = parse_logs(stream_lines(spark, str(folder)).drop("ingest_ts"), "value", ingest_ts=F.lit("2024-01-01").cast("timestamp"))
    out = st.run_to_table(parsed.select("level", "source", "message", "format"), "follow-test")
    assert sorted(tuple(r) for r in out.collect()) == [
        ("INFO", "a", "b", "application"),
        ("INFO", "unknown", "free text", "generic"),
        ("WARN", "unknown", "m", "json"),
    ]


def test_following_from_the_end_skips_what_was_there(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "old.log").write_text("old\n")
    later = stream_lines(spark, str(folder), from_end=True, started="2200-01-01 00:00:00")
    assert st.run_to_table(later.select("value"), "from-end").count() == 0
    everything = stream_lines(spark, str(folder), from_end=True, started="2000-01-01 00:00:00")
    assert [r["value"] for r in st.run_to_table(everything.select("value"), "from-start").collect()] == ["old"]


def test_repeats_within_a_day_of_the_last_kept_are_dropped(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    rows = [
        ("m", START), ("m", START + hour), ("n", START), ("m", START + 25 * hour), ("m", START + 26 * hour), ("u", None),
        ("m", START + 48 * hour), ("o", START + 48 * hour), ("m", START + 49 * hour), ("n", START + 50 * hour),
    ]
    rows = [(m, t, i) for i, (m, t) in enumerate(rows)]
    expected = [0, 2, 3, 5, 7, 8, 9]
    kind = "message string, ts timestamp, line_no long"
    batch = st.first_in_a_day(spark.createDataFrame(rows, kind))
    assert sorted(r["line_no"] for r in batch.collect()) == expected
    # however the rows fall into triggers, a row dated far ahead among them
    for name, cuts in (("one", [10]), ("three", [3, 7, 10]), ("each", list(range(1, 11)))):
        parts = [rows[a:b] for a, b in zip([0, *cuts], cuts)]
        parts[0] = [*parts[0], ("future", dt.datetime(2099, 1, 1), 99)]
        stream = _batches(spark, tmp_path / name, parts, kind)
        out = str(tmp_path / f"{name}-out")
        st.start_dedup(stream, out, str(tmp_path / f"{name}-checkpoint"), availableNow=True).awaitTermination()
        assert sorted(r["line_no"] for r in spark.read.parquet(out).collect()) == [*expected, 99]


def test_late_rows_are_dropped_from_windows(spark, tmp_path):
    row = lambda s: (START + dt.timedelta(seconds=s), "src", "ERROR", True)
    # a trigger drops what was late when the trigger before it ended
    parts = [[row(0), row(600)], [row(601)], [row(5), row(605)], [row(100_000)]]
    stream = _batches(spark, tmp_path / "in", parts, "ts timestamp, source string, level string, is_anomaly boolean")
    out = st.run_to_table(st.sliding_counts(stream, ["source"], watermark="60 seconds"), "late-test")
    lines = {r["window_start"]: r["lines"] for r in out.collect()}
    # the row at 5 s came after the watermark had passed 540 s
    assert lines[START] == 1
    assert lines[START + dt.timedelta(seconds=600)] == 3


def test_counters_over_many_triggers(spark, tmp_path):
    parts = [[("high", True), ("low", False)], [("high", True)]]
    stream = _batches(spark, tmp_path / "in", parts, "severity string, is_anomaly boolean")
    out = st.run_to_table(st.severity_counters(stream), "counter-test", "complete")
    assert [tuple(r) for r in out.collect()] == [("high", 2)]


def test_folder_to_outbox_in_one_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    (folder / "a.log").write_text(
        "2024-03-01 10:00:00 [ERROR] auth login failed\n"
        "2024-03-01 10:00:05 [ERROR] auth login failed\n"
        "2024-03-01 10:02:00 [ERROR] auth login failed\n"
        "2024-03-01 10:02:00 [INFO] auth fine\n"
    )
    score = F.when(F.col("message").contains("failed"), 0.95).otherwise(0.1)
    detected = st.detect_stream(stream_lines(spark, str(folder)).drop("ingest_ts"), score)
    outbox = str(tmp_path / "outbox")
    query = st.start_alerting(detected, read_config(SETTINGS, {}), outbox, str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination()
    rows = read_outbox(spark, outbox).orderBy("ts").collect()
    assert [r["ts"] for r in rows] == [dt.datetime(2024, 3, 1, 10), dt.datetime(2024, 3, 1, 10, 2)]
