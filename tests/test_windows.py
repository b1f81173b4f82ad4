"""Windows that close, late rows, keyed cooldown state and the live monitor, over several triggers and restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sievelog.operators import profile
from sievelog.operators.cooldown import apply_cooldown
from sievelog.streaming import streams as st

START = dt.datetime(2024, 3, 1, 8)
ROWS = "line_no bigint, source string, level string, is_anomaly boolean, ts timestamp"


def _rows(seed, n=160):
    rnd = random.Random(seed)
    rows, at = [], 0.0
    for i in range(n):
        at += rnd.choice([0, 0.25, 1, 5, 20])
        seen = at - rnd.choice([0, 0, 0, 30, 90, 400])
        ts = None if i % 40 == 39 else START + dt.timedelta(seconds=seen)
        rows.append((i, rnd.choice(["a", "b", None]), rnd.choice(["ERROR", "INFO", None]), rnd.choice([True, False, None]), ts))
    return rows


def _triggers(spark, folder, parts, kinds, start):
    """Each part is a trigger of a query that is started anew."""
    for rows in parts:
        spark.createDataFrame(rows, kinds).write.mode("append").parquet(str(folder))
        start(spark.readStream.schema(kinds).parquet(str(folder))).awaitTermination()


def _walk_windows(parts):
    """(closed windows, late counts) by going through the rows of each trigger."""
    base = START.replace(tzinfo=dt.timezone.utc)
    open_, closed, late, newest = {}, [], {}, None
    for rows in parts:
        mark = None if newest is None else newest - 60
        for line_no, source, level, anomaly, ts in rows:
            if ts is None:
                continue
            s = (ts.replace(tzinfo=dt.timezone.utc) - base).total_seconds()
            newest = s if newest is None else max(newest, s)
            for j in range(6):
                start = (s // 10 - j) * 10
                if mark is not None and start + 60 <= mark:
                    late[line_no] = late.get(line_no, 0) + 1
                else:
                    w = open_.setdefault((start, source), [0, 0, 0])
                    w[0] += 1
                    w[1] += level == "ERROR"
                    w[2] += anomaly is True
        for key in [k for k in open_ if k[0] + 60 <= newest - 60]:
            closed.append((*key, *open_.pop(key)))
    return sorted(closed, key=repr), late


@pytest.mark.parametrize("seed", [1, 2])
def test_closed_windows_and_late_rows(spark, tmp_path, seed):
    rows = _rows(seed)
    parts = [rows[i : i + 40] for i in range(0, 160, 40)]
    out = str(tmp_path / "out")
    _triggers(spark, tmp_path / "in", parts, ROWS, lambda s: st.start_windows(s, ["source"], out, str(tmp_path / "cp"), availableNow=True))
    closed, late = _walk_windows(parts)
    base = F.unix_micros(F.lit(START.isoformat()).cast("timestamp"))
    found = spark.read.parquet(out).withColumn("start", (F.unix_micros("window_start") - base) / 1_000_000)
    found = [(r.start, r.source, r.lines, round(r.error_ratio * r.lines), r.anomalies) for r in found.collect()]
    assert sorted(found, key=repr) == closed and len(closed) > 50
    assert {r.line_no: r.late_windows for r in spark.read.parquet(f"{out}-late").collect()} == late and len(late) > 5


ALERTS = "id string, line_no bigint, ts timestamp, cooldown int, deliverable boolean"


def test_cooldown_state_over_triggers_and_restarts_equals_batch(spark, tmp_path):
    rnd = random.Random(4)
    rows, at = [], 0
    for i in range(240):
        at += rnd.randint(0, 12)
        rows.append((rnd.choice("abcd"), i, START + dt.timedelta(seconds=at), rnd.choice([0, 20, 60]), i % 9 > 0))
    parts = [rows[i : i + 48] for i in range(0, 240, 48)]
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def start(stream):
        sent = st.stream_cooldown_keyed(stream)
        return sent.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)

    _triggers(spark, tmp_path / "in", parts, ALERTS, start)
    batch = apply_cooldown(spark.createDataFrame(rows, ALERTS).where("deliverable"))
    found = sorted(r.line_no for r in spark.read.parquet(out).collect())
    assert found == sorted(r.line_no for r in batch.collect()) and len(found) > 20


def test_live_monitor_equals_the_batch_row(spark, tmp_path):
    rows = [r for r in _rows(3, 90)]
    monitor = st.LiveMonitor()
    spark.streams.addListener(monitor)
    try:

        def start(stream):
            watched = monitor.watch(stream, errors=F.col("source").isNull())
            return watched.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

        _triggers(spark, tmp_path / "in", [rows[:30], rows[30:60], rows[60:]], ROWS, start)
        assert monitor.ended.wait(60)
    finally:
        spark.streams.removeListener(monitor)
    whole = profile.monitor_stats(spark.createDataFrame(rows, ROWS), errors=F.col("source").isNull()).head()
    assert monitor.stats() == whole.asDict() and monitor.triggers == 3
