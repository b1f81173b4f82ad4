"""Schemas of the tables passed between operators."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_ENTRY = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("ts_wall", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("raw_log", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("format", T.StringType()),
    ]
)

LABELLED = T.StructType(
    [
        T.StructField("message", T.StringType()),
        T.StructField("raw_log", T.StringType()),
        T.StructField("is_anomaly", T.BooleanType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

RULE = T.StructType(
    [
        T.StructField("priority", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("cooldown", T.IntegerType()),
        T.StructField("channels", T.ArrayType(T.StringType())),
        T.StructField("enabled", T.BooleanType()),
    ]
)

CHANNEL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("enabled", T.BooleanType()),
        T.StructField("target", T.StringType()),
    ]
)

ALERT_COLUMNS = (
    "id",
    "ts",
    "severity",
    "confidence",
    "log_message",
    "anomaly_details",
    "source",
    "metadata",
)
