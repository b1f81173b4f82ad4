import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from sievelog.operators import alerts as al
from sievelog.operators.scoring import detect, severity
from sievelog.plans.alerting import ENV, SETTINGS

SCORES = (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.5, 0.49)


def _alerts(spark, scores=SCORES, message="a {source} message", threshold=0.0):
    rows = [(i, dt.datetime(2024, 1, 15, 10, 0, i), message, "svc", s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "line_no bigint, ts timestamp, message string, source string, score double")
    return al.create_alerts(detect(df, "score", threshold), keep=("line_no",))


def test_severities(spark):
    df = spark.createDataFrame([(s,) for s in SCORES], "s double")
    found = [r[0] for r in df.select(severity(F.col("s"))).collect()]
    assert found == ["critical", "critical", "high", "high", "high", "high", "medium", "low"]


def test_alert_of_a_high_score(spark):
    row = _alerts(spark, (0.8,)).collect()[0]
    assert (row["severity"], row["confidence"], row["source"]) == ("high", 0.8, "svc")
    assert row["anomaly_details"] == "Batch anomaly detected with 80.0% confidence"
    assert len(row["id"]) == 12


def test_rule_order(spark):
    by_threshold = al.read_config(SETTINGS, ENV)
    by_name = al.read_config(SETTINGS, ENV, by_name=True)
    rule = {
        kind: [r["rule"] for r in al.match_rules(_alerts(spark), c).orderBy("line_no").collect()]
        for kind, c in (("threshold", by_threshold), ("name", by_name))
    }
    assert rule["threshold"] == ["high_severity"] * 2 + ["medium_severity"] * 4 + ["low_severity", None]
    assert rule["name"] == ["high_severity"] * 2 + ["low_severity"] * 5 + [None]


def test_disabled_rules_and_defaults(spark):
    config = al.read_config(
        {"alerting": {"rules": {"off": {"threshold": 0.1, "enabled": False}, "on": {}}, "channels": {}}}, {}
    )
    assert [(r.name, r.threshold, r.cooldown, r.channels) for r in config.rules if r.enabled] == [
        ("on", 0.5, 300, ())
    ]
    rows = al.match_rules(_alerts(spark), config).orderBy("line_no").collect()
    assert [r["rule"] for r in rows] == ["on"] * 7 + [None]
    assert not any(r["deliverable"] for r in rows)
    assert al.sent_alerts(_alerts(spark), config, "line_no").count() == 0


def test_no_rules(spark):
    assert al.match_rules(_alerts(spark), al.read_config({}, {})).where("rule is not null").count() == 0
    assert al.read_config_file("/nowhere/alerting.yaml", {}).rules == ()


@pytest.mark.parametrize(
    "settings, expected",
    [
        ({"recipients": ["a@b.c"]}, True),
        ({"recipients": []}, False),
        ({"recipients": ["a@b.c"], "enabled": False}, False),
        ({}, False),
    ],
)
def test_email_needs_recipients(settings, expected):
    assert al.Channel("email", settings).deliverable is expected
    assert al.Channel("slack", {"webhook_url": "u"}).deliverable
    assert not al.Channel("webhook", {"url": ""}).deliverable


def test_templates_do_not_expand_log_text(spark):
    row = _alerts(spark, (0.95,)).select(
        al.render("{severity}|{timestamp}|{confidence}|{log_message}|{source}|{{kept}}").alias("t")
    ).collect()[0]
    assert row["t"] == "CRITICAL|2024-01-15 10:00:00|95.0%|a {source} message|svc|{kept}"
    with pytest.raises(KeyError):
        al.render("{unknown}")


def test_environment_is_filled_in():
    config = al.read_config(SETTINGS, {"SLACK_URL": "https://s"})
    assert config.channels["slack"].target == "https://s"
    assert config.channels["email"].target == "${ALERT_EMAIL}, security@example.com"


def test_unknown_channels_are_not_routed(spark):
    config = al.read_config(
        {
            "alerting": {
                "channels": {"slack": {"webhook_url": "u"}, "pager": {"url": "u"}},
                "rules": {"r": {"threshold": 0.5, "cooldown": 0, "channels": ["pager", "slack"]}},
            }
        },
        {},
    )
    sent = al.sent_alerts(_alerts(spark), config, "line_no")
    routed = al.route(sent, config).collect()
    assert len(routed) == 7 and {r["channel"] for r in routed} == {"slack"}


def test_payloads_are_json(spark):
    config = al.with_channel(al.read_config(SETTINGS, ENV), "webhook", url="https://w")
    sent = al.sent_alerts(_alerts(spark, message='quote " and \\ and\nline'), config, "line_no")
    out = al.payloads(al.route(sent, config), config).collect()
    made = {r["channel"]: json.loads(r["payload"]) for r in out}
    # one identity: only its first alert goes out
    assert set(made) == {"email", "slack"}
    assert made["slack"]["attachments"][0]["color"] == "#ff0000"
    assert made["slack"]["attachments"][0]["ts"] == int(
        dt.datetime(2024, 1, 15, 10, tzinfo=dt.timezone.utc).timestamp()
    )
    assert 'quote " and \\ and\nline' in made["email"]["body"]
    low = al.sent_alerts(_alerts(spark, (0.6,)), config, "line_no")
    hook = json.loads(al.payloads(al.route(low, config), config).collect()[0]["payload"])
    assert hook["timestamp"] == "2024-01-15T10:00:00" and hook["alert"]["severity"] == "medium"


def test_suppression_resets_on_the_hour(spark):
    rows = [(0, dt.datetime(2024, 1, 1, 10, 59, 59), "m", "s", 0.95), (1, dt.datetime(2024, 1, 1, 11, 0, 0), "m", "s", 0.95)]
    df = spark.createDataFrame(rows, "line_no bigint, ts timestamp, message string, source string, score double")
    made = al.create_alerts(detect(df, "score", 0.5), keep=("line_no",))
    assert al.sent_alerts(made, al.read_config(SETTINGS, ENV), "line_no").count() == 2


def test_alerts_without_a_time_are_dated_and_sent(spark):
    rows = [("a", None, 0.95, True, "s", 1), ("b", None, 0.95, True, "s", 2)]
    df = spark.createDataFrame(rows, "message string, ts timestamp, anomaly_score double, is_anomaly boolean, source string, line_no long")
    made = al.create_alerts(df, keep=("line_no",))
    assert made.where("id is null or ts is null").count() == 0
    from sievelog.operators.cooldown import apply_cooldown

    assert apply_cooldown(made.withColumn("cooldown", F.lit(60))).count() == 2
    fixed = al.create_alerts(df, now=F.lit("2024-01-02 03:04:05").cast("timestamp")).select("ts").distinct().collect()
    assert [str(r.ts) for r in fixed] == ["2024-01-02 03:04:05"]
