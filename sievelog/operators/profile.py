"""Counts, traffic profiles and attack patterns over detected or parsed entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievelog.operators.ordered import ROWS_PER_CELL, Running, add_quantile_cells, running


def severity_counts(detected: DataFrame) -> DataFrame:
    return detected.where("is_anomaly").groupBy("severity").agg(F.count(F.lit(1)).alias("anomalies"))


def run_totals(detected: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows, anomalies and the time of the latest anomaly."""
    return detected.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("is_anomaly")).alias("anomalies_detected"),
        F.max(F.when(F.col("is_anomaly"), F.col(ts))).alias("last_alert"),
    )


def monitor_stats(detected: DataFrame, ts: str = "ts", errors: Column | None = None) -> DataFrame:
    """Lines, anomalies, errors, elapsed event time, lines per second and anomaly rate."""
    errors = F.lit(False) if errors is None else errors
    micros = F.unix_micros(F.col(ts))
    counted = detected.agg(
        F.count(F.lit(1)).alias("lines_processed"),
        F.count_if(F.col("is_anomaly")).alias("anomalies_detected"),
        F.count_if(errors).alias("errors"),
        ((F.max(micros) - F.min(micros)) / 1e6).alias("elapsed_seconds"),
    )
    lines = F.col("lines_processed")
    return counted.withColumns(
        {
            "lines_per_second": F.when(F.col("elapsed_seconds") > 0, lines / F.col("elapsed_seconds")),
            "anomaly_rate": F.col("anomalies_detected") / F.greatest(lines, F.lit(1)),
        }
    )


def hour_multiplier(hour: Column) -> Column:
    """Expected share of the base rate at an hour of the day."""
    return F.when(hour.between(9, 17), 1.5).when((hour >= 22) | (hour <= 6), 0.3).otherwise(1.0)


def hourly_profile(df: DataFrame, base_rate: float, ts: str = "ts") -> DataFrame:
    """Lines per hour against the number the time of day leads one to expect."""
    hourly = df.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour_start")).agg(
        F.count(F.lit(1)).alias("lines")
    )
    expected = hour_multiplier(F.hour("hour_start")) * F.lit(float(base_rate))
    return hourly.withColumn("expected", expected).withColumn("ratio", F.col("lines") / F.col("expected"))


def failure_bursts(
    df: DataFrame, key: str, failed: Column, min_failures: int = 5, window: str = "10 minutes", ts: str = "ts"
) -> DataFrame:
    """Tumbling windows in which one address or actor fails at least ``min_failures`` times."""
    return (
        df.where(failed & F.col(key).isNotNull())
        .groupBy(key, F.window(ts, window).alias("w"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .where(F.col("failures") >= min_failures)
        .select(key, F.col("w.start").alias("window_start"), "failures")
    )


def success_after_failures(
    df: DataFrame,
    key: str,
    failed: Column,
    succeeded: Column,
    min_failures: int = 5,
    ts: str = "ts",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Times at which an actor succeeds after at least ``min_failures`` earlier failures.

    Rows are first combined per actor and time, so what is ordered is at most one row per distinct time.
    """
    moments = (
        df.where((failed | succeeded) & F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(key, ts)
        .agg(F.count_if(failed).alias("failures"), F.count_if(succeeded).alias("successes"))
    )
    celled = add_quantile_cells(moments, F.col(ts), rows_per_cell)
    before = {"failures_before": Running("sum", F.col("failures"), inclusive=False)}
    return (
        running(celled, [key], [F.col(ts)], F.col("cell"), before)
        .where((F.col("successes") > 0) & (F.col("failures_before") >= min_failures))
        .select(key, ts, "failures_before", "successes")
    )


def activity_sessions(
    df: DataFrame,
    key: str,
    gap_seconds: int = 60,
    min_events: int = 1,
    ts: str = "ts",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Sessions of one source: runs of rows no more than ``gap_seconds`` apart, with at least ``min_events``.

    A source of any size is spread over cells of time: the previous time is a running maximum and the session
    number a running sum, and a session is counted with partial aggregates.
    """
    moments = (
        df.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        .groupBy(key, ts)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    )
    celled = add_quantile_cells(moments, F.col(ts), rows_per_cell, "_tcell")
    place, cell = [F.col("_t")], F.col("_tcell")
    previous = running(celled, [key], place, cell, {"_prev": Running("max", F.col("_t"), inclusive=False)})
    opens = F.when(
        F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > gap_seconds * 1_000_000), 1
    ).otherwise(0)
    numbered = running(
        previous.withColumn("_opens", opens), [key], place, cell, {"_session": Running("sum", F.col("_opens"))}
    )
    return (
        numbered.groupBy(key, "_session")
        .agg(
            F.min(ts).alias("session_start"),
            F.max(ts).alias("session_end"),
            F.sum("n").alias("events"),
        )
        .where(F.col("events") >= min_events)
        .drop("_session")
    )


def sort_by_time(df: DataFrame, ts: str = "ts", order: str = "line_no") -> DataFrame:
    """Global order by time, ties by position: a range-partitioned sort."""
    return df.orderBy(ts, order)


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows: each task keeps its own ``n`` and only those meet."""
    return df.orderBy(*order).limit(n)
