"""Registered queries: alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievelog.operators import alerts as al
from sievelog.operators import scoring
from sievelog.operators.cooldown import apply_cooldown
from sievelog.plans.views import scored
from sievelog.plans.views_sql import SCORED

SETTINGS = """
alerting:
  channels:
    email:
      enabled: true
      username: "${ALERT_USER}"
      recipients: ["${ALERT_EMAIL}", "security@example.com"]
    slack:
      enabled: true
      webhook_url: "${SLACK_URL}"
      channel: "#security-alerts"
    webhook:
      enabled: false
      url: "https://hooks.example.com/alerts"
  rules:
    high_severity: {threshold: 0.9, cooldown: 300, channels: [email, slack]}
    medium_severity: {threshold: 0.7, cooldown: 600, channels: [slack]}
    low_severity: {threshold: 0.5, cooldown: 1800, channels: [webhook]}
  templates:
    email:
      subject: "Security Alert - {severity} Severity"
      body: "Time: {timestamp} Severity: {severity} Confidence: {confidence} Log: {log_message} Source: {source}"
    slack:
      message: "*{severity}* {timestamp} {confidence}% `{log_message}` {anomaly_details} {alert_id} {{as is}}"
"""
ENV = {
    "ALERT_USER": "alerts@example.com",
    "ALERT_EMAIL": "ops@example.com",
    "SLACK_URL": "https://chat.example.com/hook",
}
THRESHOLD = 0.5


def config(by_name: bool = False) -> al.AlertConfig:
    return al.read_config(SETTINGS, ENV, by_name)


def detected(spark, sf_dir) -> DataFrame:
    entries = scored(spark, sf_dir).drop("is_anomaly", "anomaly_score")
    return scoring.detect(entries, "score", THRESHOLD)


def alerts(spark, sf_dir) -> DataFrame:
    return al.create_alerts(detected(spark, sf_dir), keep=("line_no",))


def time_text(column: str = "ts"):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts")


def alert_id(spark, sf_dir):
    made = al.alert_id(F.col("message"), F.col("source"), F.col("ts")).alias("id")
    return scored(spark, sf_dir).select("line_no", made)


def create_alerts(spark, sf_dir):
    return alerts(spark, sf_dir).select(
        "line_no", "id", time_text(), "severity", "confidence", "log_message", "anomaly_details", "source"
    )


def _matched(by_name: bool):
    def query(spark, sf_dir):
        out = al.match_rules(alerts(spark, sf_dir), config(by_name))
        return out.select("line_no", "rule", "cooldown", F.array_join("channels", ",").alias("channels"), "deliverable")

    return query


def cooldown(spark, sf_dir):
    """Alerts that go out under the rules and cooldowns."""
    return al.sent_alerts(alerts(spark, sf_dir), config(), "line_no").select("line_no", "id")


def cooldown_by_source(spark, sf_dir):
    """At most one alert per source and half hour, counted from the last one sent."""
    kept = apply_cooldown(alerts(spark, sf_dir), "source", "ts", "line_no", 1800)
    return kept.select("line_no", "source")


def cooldown_by_source_rounds(spark, sf_dir):
    """The same with every source cut into cells of about a hundred alerts, whose maps are composed in rounds."""
    kept = apply_cooldown(alerts(spark, sf_dir), "source", "ts", "line_no", 1800, rows_per_cell=100)
    return kept.select("line_no", "source")


def route_channels(spark, sf_dir):
    sent = al.sent_alerts(alerts(spark, sf_dir), config(), "line_no")
    return al.route(sent, config()).select("line_no", "channel", "channel_delivers")


def deliverable(spark, sf_dir):
    """Alerts per channel of their rule with whether the channel can deliver."""
    matched = al.match_rules(alerts(spark, sf_dir), config())
    routed = matched.select(F.explode("channels").alias("name"))
    channels = al.channel_table(spark, config()).withColumn(
        "deliverable", al.deliverable(F.col("enabled"), F.col("target"))
    )
    counted = routed.groupBy("name").agg(F.count(F.lit(1)).alias("alerts"))
    return counted.join(channels, "name").select("name", "alerts", "enabled", "target", "deliverable")


def render_template(spark, sf_dir):
    made = config()
    return alerts(spark, sf_dir).select(
        "line_no",
        al.render(made.templates["email"]).alias("email_text"),
        al.render(made.templates["slack"]).alias("slack_text"),
    )


def severity_colour(spark, sf_dir):
    return alerts(spark, sf_dir).select("line_no", al.severity_colour(F.col("severity")).alias("colour"))


def alert_stats(spark, sf_dir):
    return al.alert_stats(al.sent_alerts(alerts(spark, sf_dir), config(), "line_no"))


def alert_payload(spark, sf_dir):
    sent = al.sent_alerts(alerts(spark, sf_dir), config(), "line_no")
    return al.payloads(al.route(sent, config()), config()).select("alert_id", "channel", time_text(), "payload")


def rule_table(spark, sf_dir):
    """The rules with the alerts each one matches."""
    matched = al.match_rules(alerts(spark, sf_dir), config()).groupBy(F.col("rule").alias("name"))
    counted = matched.agg(F.count(F.lit(1)).alias("alerts"))
    rules = al.rule_table(spark, config())
    return rules.join(counted, "name").select(
        "priority", "name", "threshold", "cooldown", F.array_join("channels", ",").alias("channels"), "enabled", "alerts"
    )


QUERIES = {
    "alert_id": alert_id,
    "create_alerts": create_alerts,
    "rule_match": _matched(False),
    "rule_match_by_name": _matched(True),
    "cooldown": cooldown,
    "cooldown_by_source": cooldown_by_source,
    "cooldown_by_source_rounds": cooldown_by_source_rounds,
    "route_channels": route_channels,
    "deliverable": deliverable,
    "render_template": render_template,
    "severity_colour": severity_colour,
    "alert_stats": alert_stats,
    "alert_payload": alert_payload,
    "rule_table": rule_table,
}

_ID = "substr(md5(message || ':' || coalesce(source, 'unknown') || ':' || strftime(ts, '%Y%m%d%H')), 1, 12)"
_SEVERITY = "CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END"
_PERCENT = "printf('%.1f', {} * 100) || '%'"
_DETAILS = f"'Batch anomaly detected with ' || {_PERCENT.format('greatest(score, 1 - score)')} || ' confidence'"
_STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"
ALERTS = f"""{SCORED}, alerts AS (SELECT line_no, {_ID} AS id, ts, {_SEVERITY} AS severity, score AS confidence, message AS log_message,
 {_DETAILS} AS anomaly_details, coalesce(source, 'unknown') AS source FROM scored WHERE score > 0.5)"""
_BY_THRESHOLD = "CASE WHEN confidence >= 0.9 THEN {high} WHEN confidence >= 0.7 THEN {medium} WHEN confidence >= 0.5 THEN {low} END"
_BY_NAME = "CASE WHEN confidence >= 0.9 THEN {high} WHEN confidence >= 0.5 THEN {low} WHEN confidence >= 0.7 THEN {medium} END"


def _matched_sql(case: str) -> str:
    rule = case.format(high="'high_severity'", medium="'medium_severity'", low="'low_severity'")
    wait = case.format(high="300", medium="600", low="1800")
    channels = case.format(high="'email,slack'", medium="'slack'", low="'webhook'")
    works = case.format(high="true", medium="true", low="false")
    return (
        f"matched AS (SELECT *, {rule} AS rule, {wait} AS cooldown, {channels} AS channels, {works} AS deliverable FROM alerts)"
    )


def _walk_sql(source: str, key: str, wait: str) -> str:
    return f"""steps AS (SELECT {key} AS k, line_no, epoch_us(ts) AS t, {wait} * 1000000::BIGINT AS c,
  row_number() OVER (PARTITION BY {key} ORDER BY ts, line_no) AS rn FROM {source}),
walk(k, rn, line_no, last, sent) AS (SELECT k, rn, line_no, t, true FROM steps WHERE rn = 1
  UNION ALL SELECT s.k, s.rn, s.line_no, CASE WHEN s.t - w.last >= s.c THEN s.t ELSE w.last END, s.t - w.last >= s.c
  FROM walk w JOIN steps s ON s.k = w.k AND s.rn = w.rn + 1)"""


_SENT = (
    f"WITH RECURSIVE {ALERTS}, {_matched_sql(_BY_THRESHOLD)}, going AS (SELECT * FROM matched WHERE deliverable), "
    f"{_walk_sql('going', 'id', 'cooldown')}, sent AS (SELECT g.* FROM going g JOIN walk w ON w.line_no = g.line_no WHERE w.sent)"
)
_ROUTED = (
    f"{_SENT}, routed AS (SELECT *, unnest(string_split(channels, ',')) AS channel FROM sent)"
)
_EMAIL_TEXT = (
    "'Time: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' Severity: ' || upper(severity) || ' Confidence: ' || "
    f"{_PERCENT.format('confidence')} || ' Log: ' || log_message || ' Source: ' || source"
)
_SLACK_TEXT = (
    f"'*' || upper(severity) || '* ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || {_PERCENT.format('confidence')} || '% `' || "
    "log_message || '` ' || anomaly_details || ' ' || id || ' {as is}'"
)
_COLOUR = "CASE severity WHEN 'low' THEN '#36a64f' WHEN 'medium' THEN '#ff9900' WHEN 'high' THEN '#ff6600' WHEN 'critical' THEN '#ff0000' ELSE '#cccccc' END"


def _field(title: str, value: str) -> str:
    return f"""'{{"title":"{title}","value":"' || {value} || '","short":true}}'"""


_EMAIL_PAYLOAD = (
    """'{"from":"alerts@example.com","to":"ops@example.com, security@example.com","subject":"Security Alert - ' || upper(severity) || """
    f"""' Severity","body":"' || {_EMAIL_TEXT} || '"}}'"""
)
_SLACK_PAYLOAD = (
    """'{"channel":"#security-alerts","username":"log alerts","icon_emoji":":warning:","text":"' || """
    f"""{_SLACK_TEXT} || '","attachments":[{{"color":"' || {_COLOUR} || '","fields":[' || {_field('Alert ID', 'id')} || ',' || """
    f"""{_field('Source', 'source')} || ',' || {_field('Confidence', _PERCENT.format('confidence'))} || '],"ts":' || """
    "CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '}]}'"
)

ORACLES = {
    "alert_id": f"WITH {SCORED} SELECT line_no, {_ID} AS id FROM scored",
    "create_alerts": f"WITH {ALERTS} SELECT line_no, id, {_STAMP} AS ts, severity, confidence, log_message, anomaly_details, source FROM alerts",
    "rule_match": f"WITH {ALERTS}, {_matched_sql(_BY_THRESHOLD)} SELECT line_no, rule, cooldown, channels, deliverable FROM matched",
    "rule_match_by_name": f"WITH {ALERTS}, {_matched_sql(_BY_NAME)} SELECT line_no, rule, cooldown, channels, deliverable FROM matched",
    "cooldown": f"{_SENT} SELECT line_no, id FROM sent",
    "cooldown_by_source": f"WITH RECURSIVE {ALERTS}, {_walk_sql('alerts', 'source', '1800')} SELECT line_no, k AS source FROM walk WHERE sent",
    "cooldown_by_source_rounds": f"WITH RECURSIVE {ALERTS}, {_walk_sql('alerts', 'source', '1800')} SELECT line_no, k AS source FROM walk WHERE sent",
    "route_channels": f"{_ROUTED} SELECT line_no, channel, channel <> 'webhook' AS channel_delivers FROM routed",
    "deliverable": f"WITH {ALERTS}, {_matched_sql(_BY_THRESHOLD)}, n AS (SELECT name, count(*) AS alerts FROM "
    "(SELECT unnest(string_split(channels, ',')) AS name FROM matched) GROUP BY name) SELECT name, alerts, enabled, target, enabled AND target <> '' AS deliverable "
    "FROM n JOIN (VALUES ('email', true, 'ops@example.com, security@example.com'), ('slack', true, 'https://chat.example.com/hook'), "
    "('webhook', false, 'https://hooks.example.com/alerts')) AS c(name, enabled, target) USING (name)",
    "render_template": f"WITH {ALERTS} SELECT line_no, {_EMAIL_TEXT} AS email_text, {_SLACK_TEXT} AS slack_text FROM alerts",
    "severity_colour": f"WITH {ALERTS} SELECT line_no, {_COLOUR} AS colour FROM alerts",
    "alert_stats": f"{_SENT} SELECT severity, count(*) AS total_alerts, count(DISTINCT id) AS active_alerts FROM sent GROUP BY severity "
    "UNION ALL SELECT 'all', count(*), count(DISTINCT id) FROM sent",
    "alert_payload": f"{_ROUTED} SELECT id AS alert_id, channel, {_STAMP} AS ts, CASE channel WHEN 'email' THEN {_EMAIL_PAYLOAD} ELSE {_SLACK_PAYLOAD} END AS payload "
    "FROM routed WHERE channel <> 'webhook'",
    "rule_table": f"WITH {ALERTS}, {_matched_sql(_BY_THRESHOLD)}, n AS (SELECT rule, count(*) AS alerts FROM matched GROUP BY rule) "
    "SELECT priority, name, threshold, cooldown, channels, true AS enabled, alerts FROM n JOIN (VALUES (0, 'high_severity', 0.9, 300, 'email,slack'), "
    "(1, 'medium_severity', 0.7, 600, 'slack'), (2, 'low_severity', 0.5, 1800, 'webhook')) AS r(priority, name, threshold, cooldown, channels) ON rule = name",
}
