import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievelog.operators import profile as pr
from sievelog.operators.predicates import from_suspicious_ip

START = dt.datetime(2024, 1, 1, 9)


def _at(seconds):
    return START + dt.timedelta(seconds=seconds)


def _logins(spark):
    rows = [("6.6.6.6", _at(12 * i), "Failed login", False) for i in range(45)]
    rows += [("6.6.6.6", _at(12 * i), "Successful login", True) for i in range(45, 50)]
    rows += [("1.1.1.1", _at(5), "Failed login", False), ("1.1.1.1", _at(9), "Successful login", True)]
    rows += [("2.2.2.2", _at(1), "Successful login", True), (None, _at(2), "Failed login", False)]
    return spark.createDataFrame(rows, "ip string, ts timestamp, message string, ok boolean")


@pytest.mark.parametrize("rows_per_cell", [4, 1000])
def test_success_after_many_failures(spark, rows_per_cell):
    df = _logins(spark)
    out = pr.success_after_failures(df, "ip", ~F.col("ok"), F.col("ok"), 5, rows_per_cell=rows_per_cell)
    rows = out.orderBy("ts").collect()
    assert {r["ip"] for r in rows} == {"6.6.6.6"}
    assert [r["failures_before"] for r in rows] == [45] * 5


def test_bursts(spark):
    rows = pr.failure_bursts(_logins(spark), "ip", ~F.col("ok"), 10).collect()
    assert [(r["ip"], r["window_start"], r["failures"]) for r in rows] == [("6.6.6.6", START, 45)]


@pytest.mark.parametrize("rows_per_cell", [2, 1000])
def test_injection_sessions(spark, rows_per_cell):
    rows = [("web", _at(30 * i)) for i in range(10)] + [("web", _at(1000)), ("web", _at(1000))]
    rows += [("db", _at(0)), ("db", _at(60)), ("db", _at(121))]
    df = spark.createDataFrame(rows, "source string, ts timestamp")
    out = pr.activity_sessions(df, "source", 60, rows_per_cell=rows_per_cell).collect()
    found = sorted((r["source"], r["session_start"], r["session_end"], r["events"]) for r in out)
    assert found == [
        ("db", _at(0), _at(60), 2),
        ("db", _at(121), _at(121), 1),
        ("web", _at(0), _at(270), 10),
        ("web", _at(1000), _at(1000), 2),
    ]
    built_in = df.groupBy("source", F.session_window("ts", "60 seconds")).count()
    assert sorted(r["count"] for r in built_in.collect()) == sorted(r["events"] for r in out)


def test_hour_profile(spark):
    df = spark.createDataFrame([(h,) for h in range(24)], "h int")
    found = {r[0]: r[1] for r in df.select("h", pr.hour_multiplier(F.col("h"))).collect()}
    assert [h for h in found if found[h] == 1.5] == list(range(9, 18))
    assert [h for h in found if found[h] == 0.3] == [*range(0, 7), 22, 23]


def test_monitor_stats_of_nothing(spark):
    empty = spark.createDataFrame([], "ts timestamp, is_anomaly boolean")
    row = pr.monitor_stats(empty).head()
    assert (row["lines_processed"], row["anomaly_rate"], row["lines_per_second"]) == (0, 0.0, None)


def test_listed_addresses(spark):
    df = spark.createDataFrame(
        [(0, "from 10.0.0.50 and 10.0.0.50"), (1, "from 110.0.0.50"), (2, "10.0.0.5"), (3, None)], "i int, message string"
    )
    listed = spark.createDataFrame([("10.0.0.50",), ("10.0.0.50",)], "ip string")
    assert [r["i"] for r in from_suspicious_ip(df).collect()] == [0]
    assert [r["i"] for r in from_suspicious_ip(df, suspicious=listed, key="i").collect()] == [0]
