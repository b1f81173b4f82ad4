"""Alerts from anomalous rows: identity, rules, cooldown, routing and payloads.

Rules, channels and templates are configuration: a handful of values the plan holds as literals. Nothing about
them is joined, so a rule that matches most alerts does not gather them anywhere.
"""

from __future__ import annotations

import os
import re
import string
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sievelog import schema
from sievelog.functions.text import iso_time, percent_one_decimal
from sievelog.operators.cooldown import apply_cooldown
from sievelog.operators.scoring import severity

# fixed values: attachment colour of each severity, and the one for anything else
COLOURS = {"low": "#36a64f", "medium": "#ff9900", "high": "#ff6600", "critical": "#ff0000"}
DEFAULT_COLOUR = "#cccccc"

# fixed values: message text used where the configuration names no templates
DEFAULT_TEMPLATES = {
    "email": "Security alert detected at {timestamp}\nSeverity: {severity}\nDetails: {anomaly_details}",
    "slack": "Security Alert: {severity} severity detected at {timestamp}",
    "webhook": "Alert: {anomaly_details}",
}
KNOWN_CHANNELS = ("email", "slack", "webhook")


@dataclass(frozen=True)
class Rule:
    name: str
    threshold: float = 0.5
    cooldown: int = 300
    channels: tuple[str, ...] = ()
    enabled: bool = True


@dataclass(frozen=True)
class Channel:
    """A delivery target; ``settings`` are the channel's own configuration values."""

    name: str
    settings: Mapping[str, object] = field(default_factory=dict)

    @property
    def target(self) -> str:
        """Where the channel delivers to; empty when it has nowhere to deliver."""
        if self.name == "email":
            return ", ".join(str(r) for r in self.settings.get("recipients") or [])
        return str(self.settings.get("webhook_url" if self.name == "slack" else "url") or "")

    @property
    def enabled(self) -> bool:
        return bool(self.settings.get("enabled", True))

    @property
    def deliverable(self) -> bool:
        return self.enabled and bool(self.target)


@dataclass(frozen=True)
class AlertConfig:
    """Rules in matching order, channels by name and message templates by channel name."""

    rules: tuple[Rule, ...] = ()
    channels: Mapping[str, Channel] = field(default_factory=dict)
    templates: Mapping[str, str] = field(default_factory=lambda: dict(DEFAULT_TEMPLATES))

    def delivers(self, rule: Rule) -> bool:
        """Whether an alert under the rule reaches any channel."""
        return any(self.channels[c].deliverable for c in rule.channels if c in self.channels)


def _filled(value, env: Mapping[str, str]):
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: env.get(m.group(1), m.group(0)), value)
    if isinstance(value, Mapping):
        return {k: _filled(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [_filled(v, env) for v in value]
    return value


def _template_text(value) -> str:
    """A template is text, or a mapping that holds the text as its body or message."""
    if isinstance(value, Mapping):
        return str(value.get("body") or value.get("message") or "")
    return str(value)


def read_config(
    settings: Mapping | str, env: Mapping[str, str] | None = None, by_name: bool = False
) -> AlertConfig:
    """Configuration from a mapping or YAML text with ``${VAR}`` filled from ``env``.

    Rules match from the highest threshold down; ``by_name`` matches them in the order of their names instead.
    """
    if isinstance(settings, str):
        import yaml

        settings = yaml.safe_load(settings) or {}
    alerting = _filled(settings, os.environ if env is None else env).get("alerting") or {}
    rules = [
        Rule(
            name,
            float(r.get("threshold", 0.5)),
            int(r.get("cooldown", 300)),
            tuple(r.get("channels") or ()),
            bool(r.get("enabled", True)),
        )
        for name, r in (alerting.get("rules") or {}).items()
    ]
    rules.sort(key=(lambda r: r.name) if by_name else (lambda r: -r.threshold))
    channels = {
        name: Channel(name, c or {})
        for name, c in (alerting.get("channels") or {}).items()
        if name in KNOWN_CHANNELS
    }
    templates = alerting.get("templates")
    if templates is None:
        templates = DEFAULT_TEMPLATES
    return AlertConfig(tuple(rules), channels, {k: _template_text(v) for k, v in templates.items()})


def read_config_file(path: str, env: Mapping[str, str] | None = None, by_name: bool = False) -> AlertConfig:
    """:func:`read_config` from a file; a missing file gives an empty configuration."""
    try:
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
    except FileNotFoundError:
        return read_config({}, env, by_name)
    return read_config(text, env, by_name)


def rule_table(spark: SparkSession, config: AlertConfig) -> DataFrame:
    rows = [
        (i, r.name, r.threshold, r.cooldown, list(r.channels), r.enabled)
        for i, r in enumerate(config.rules)
    ]
    return spark.createDataFrame(rows, schema.RULE)


def channel_table(spark: SparkSession, config: AlertConfig) -> DataFrame:
    rows = [(c.name, c.enabled, c.target) for c in config.channels.values()]
    return spark.createDataFrame(rows, schema.CHANNEL)


def deliverable(enabled: Column, target: Column) -> Column:
    return F.coalesce(enabled & (target != ""), F.lit(False))


def alert_id(message: Column, source: Column, ts: Column) -> Column:
    """First 12 hex digits of the hash of message, source and hour."""
    content = F.concat(
        F.coalesce(message, F.lit("")),
        F.lit(":"),
        F.coalesce(source, F.lit("unknown")),
        F.lit(":"),
        F.date_format(ts, "yyyyMMddHH"),
    )
    return F.substring(F.md5(content), 1, 12)


def create_alerts(
    detected: DataFrame, keep: Sequence[str] = (), batch: bool = True, ts: str = "ts", now: Column | None = None
) -> DataFrame:
    """One alert per anomalous row; ``confidence`` of an alert is the raw score.

    A row without a readable time is dated ``now`` (its ``ingest_ts`` if it has one, else the current time), so it
    has an identity and passes the cooldown like any other.
    """
    if now is None:
        now = F.col("ingest_ts") if "ingest_ts" in detected.columns else F.current_timestamp()
    when = F.coalesce(F.col(ts), now.cast(detected.schema[ts].dataType))
    share = F.greatest(F.col("anomaly_score"), 1 - F.col("anomaly_score"))
    opening = "Batch anomaly detected with " if batch else "Anomaly detected with "
    metadata = F.col("metadata") if "metadata" in detected.columns else F.lit("{}")
    return detected.where("is_anomaly").select(
        alert_id(F.col("message"), F.col("source"), when).alias("id"),
        when.alias("ts"),
        severity(F.col("anomaly_score")).alias("severity"),
        F.col("anomaly_score").alias("confidence"),
        F.col("message").alias("log_message"),
        F.concat(F.lit(opening), percent_one_decimal(share), F.lit(" confidence")).alias("anomaly_details"),
        F.coalesce("source", F.lit("unknown")).alias("source"),
        metadata.alias("metadata"),
        *keep,
    )


def match_rules(alerts: DataFrame, config: AlertConfig, score: str = "confidence") -> DataFrame:
    """Add the first enabled rule whose threshold the score reaches: name, cooldown, channels, deliverable."""
    chosen = F
    for rule in config.rules:
        if rule.enabled:
            channels = (
                F.array(*[F.lit(c) for c in rule.channels])
                if rule.channels
                else F.array().cast("array<string>")
            )
            chosen = chosen.when(
                F.col(score) >= rule.threshold,
                F.struct(
                    F.lit(rule.name).alias("name"),
                    F.lit(rule.cooldown).alias("cooldown"),
                    channels.alias("channels"),
                    F.lit(config.delivers(rule)).alias("deliverable"),
                ),
            )
    if chosen is F:
        kind = "struct<name:string,cooldown:int,channels:array<string>,deliverable:boolean>"
        chosen = F.lit(None).cast(kind)
    alerts = alerts.withColumn("_rule", chosen)
    return alerts.withColumns(
        {
            "rule": F.col("_rule.name"),
            "cooldown": F.col("_rule.cooldown"),
            "channels": F.col("_rule.channels"),
            "deliverable": F.coalesce("_rule.deliverable", F.lit(False)),
        }
    ).drop("_rule")


def sent_alerts(alerts: DataFrame, config: AlertConfig, order: str, **limits) -> DataFrame:
    """Alerts that go out: matched by a rule that reaches a channel, and past the cooldown of their identity."""
    matched = match_rules(alerts, config).where("deliverable")
    return apply_cooldown(matched, "id", "ts", order, "cooldown", **limits)


def route(sent: DataFrame, config: AlertConfig) -> DataFrame:
    """One row per alert and configured channel of its rule, with whether that channel can deliver."""
    known = list(config.channels)
    reach = [c for c in known if config.channels[c].deliverable]
    routed = sent.withColumn("channel", F.explode("channels"))
    return routed.where(F.col("channel").isin(known)).withColumn(
        "channel_delivers", F.col("channel").isin(reach)
    )


def _alert_fields(ts: str) -> dict[str, Column]:
    return {
        "timestamp": F.date_format(ts, "yyyy-MM-dd HH:mm:ss"),
        "severity": F.upper("severity"),
        "confidence": percent_one_decimal(F.col("confidence")),
        "log_message": F.col("log_message"),
        "anomaly_details": F.col("anomaly_details"),
        "source": F.col("source"),
        "alert_id": F.col("id"),
    }


def render(template: str, ts: str = "ts") -> Column:
    """Fill a template. It is split here, so braces in log text are never read as placeholders."""
    fields = _alert_fields(ts)
    parts: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(fields[name], F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def severity_colour(level: Column) -> Column:
    out = F
    for name, colour in COLOURS.items():
        out = out.when(F.lower(level) == name, colour)
    return out.otherwise(DEFAULT_COLOUR)


def payloads(
    routed: DataFrame, config: AlertConfig, sender: str = "log alerts", subject: str = "Security Alert"
) -> DataFrame:
    """``(alert_id, channel, ts, payload)``: what each deliverable channel would be sent, as JSON text."""
    default = config.templates.get("default", "")
    text = {c: render(config.templates.get(c, default)) for c in config.channels}
    payload = F
    for name, channel in config.channels.items():
        body = text[name]
        if name == "email":
            made = F.struct(
                F.lit(str(channel.settings.get("username") or "")).alias("from"),
                F.lit(channel.target).alias("to"),
                F.concat(F.lit(f"{subject} - "), F.upper("severity"), F.lit(" Severity")).alias("subject"),
                body.alias("body"),
            )
        elif name == "slack":
            pairs = (
                ("Alert ID", F.col("id")),
                ("Source", F.col("source")),
                ("Confidence", percent_one_decimal(F.col("confidence"))),
            )
            shown = [
                F.struct(F.lit(t).alias("title"), v.alias("value"), F.lit(True).alias("short"))
                for t, v in pairs
            ]
            made = F.struct(
                F.lit(str(channel.settings.get("channel", "#security-alerts"))).alias("channel"),
                F.lit(sender).alias("username"),
                F.lit(":warning:").alias("icon_emoji"),
                body.alias("text"),
                F.array(
                    F.struct(
                        severity_colour(F.col("severity")).alias("color"),
                        F.array(*shown).alias("fields"),
                        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"),
                    )
                ).alias("attachments"),
            )
        else:
            stamp = iso_time(F.col("ts"))
            alert = F.struct(
                "id",
                stamp.alias("timestamp"),
                "severity",
                "confidence",
                "log_message",
                "anomaly_details",
                "source",
                "metadata",
            )
            made = F.struct(alert.alias("alert"), body.alias("message"), stamp.alias("timestamp"))
        payload = payload.when(F.col("channel") == name, F.to_json(made))
    return (
        routed.where("channel_delivers")
        .withColumn("payload", payload)
        .select(F.col("id").alias("alert_id"), "channel", "ts", "payload")
    )


def alert_stats(sent: DataFrame) -> DataFrame:
    """Total alerts sent and distinct identities, over all and by severity."""
    per_id = sent.groupBy("severity", "id").agg(F.count(F.lit(1)).alias("n"))
    by_severity = per_id.groupBy("severity").agg(
        F.sum("n").alias("total_alerts"), F.count(F.lit(1)).alias("active_alerts")
    )
    overall = (
        per_id.groupBy("id")
        .agg(F.sum("n").alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts"), F.count(F.lit(1)).alias("active_alerts"))
        .select(F.lit("all").alias("severity"), "total_alerts", "active_alerts")
    )
    return by_severity.unionByName(overall)


def with_channel(config: AlertConfig, name: str, **settings) -> AlertConfig:
    """The configuration with one channel's settings replaced."""
    return replace(config, channels={**config.channels, name: Channel(name, settings)})
