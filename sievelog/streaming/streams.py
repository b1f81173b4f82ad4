"""Streaming forms of the operators. Row-wise ones (parse, features, detect) are used as they are."""

from __future__ import annotations

import datetime
import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sievelog.operators.alerts import AlertConfig, create_alerts, match_rules, payloads, route
from sievelog.operators.cooldown import apply_cooldown
from sievelog.operators.ordered import whole_division
from sievelog.operators.parse import parse_logs
from sievelog.operators.scoring import DEFAULT_THRESHOLD, Scorer, detect
from sievelog.session import scratch_path, ship_package
from sievelog.sources.writers import append_outbox


def sliding_counts(
    df: DataFrame,
    keys: list[str],
    window: str = "60 seconds",
    slide: str = "10 seconds",
    ts: str = "ts",
    watermark: str | None = None,
) -> DataFrame:
    """Lines, errors and anomalies per sliding window and key, on a table or a stream.

    On a stream ``watermark`` is how late a row may be; later ones are dropped and reported by the query's
    progress as ``numRowsDroppedByWatermark``.
    """
    if watermark:
        df = df.withWatermark(ts, watermark)
    return (
        df.groupBy(F.window(ts, window, slide).alias("w"), *keys)
        .agg(
            F.count(F.lit(1)).alias("lines"),
            F.avg(F.coalesce(F.col("level") == "ERROR", F.lit(False)).cast("int")).alias("error_ratio"),
            F.count_if("is_anomaly").alias("anomalies"),
        )
        .select(F.col("w.start").alias("window_start"), *keys, "lines", "error_ratio", "anomalies")
    )


def severity_counters(detected: DataFrame) -> DataFrame:
    """Running anomaly counts by severity; write with output mode ``complete`` or ``update``."""
    return detected.where("is_anomaly").groupBy("severity").agg(F.count(F.lit(1)).alias("anomalies"))


def start_windows(
    df: DataFrame,
    keys: list[str],
    out: str,
    checkpoint: str,
    window: int = 60,
    slide: int = 10,
    delay: int = 60,
    ts: str = "ts",
    **trigger,
) -> StreamingQuery:
    """:func:`sliding_counts` in windows that close, with a table of the rows that came too late for some.

    Seconds throughout; ``window`` is a multiple of ``slide``. A micro-batch's watermark is ``delay`` before the newest
    time of all batches before it. A row is counted in those of its windows that end after the watermark; if there are
    others, it goes to ``{out}-late`` with ``late_windows``, their number. Windows that end by the next watermark are
    written once to ``out``. Unlike the count in a query's progress, which is of partial sums, this one is of rows.
    Rows without a time are in no window.

    The sums of open windows and the newest time are a table per batch, in slots that a replay overwrites; so are rows
    and windows, in folders named by batch.
    """
    spark = df.sparkSession
    width, step, wait = (1_000_000 * x for x in (window, slide, delay))
    sums = {"lines": F.lit(1), "errors": F.coalesce(F.col("level") == "ERROR", F.lit(False)).cast("int"), "anomalies": F.coalesce("is_anomaly", F.lit(False)).cast("int")}
    kinds = T.StructType().add("start", "long")
    for key in keys:
        kinds = kinds.add(df.schema[key])
    kinds = kinds.add("lines", "long").add("errors", "long").add("anomalies", "long")
    ends = F.col("start") + width

    def close(batch: DataFrame, batch_id: int) -> None:
        us = F.unix_micros(F.col(ts).cast("timestamp"))
        rows = batch.where(F.col(ts).isNotNull()).withColumn("_us", us).persist()
        before = _history(spark, f"{out}-newest", batch_id, "newest bigint").agg(F.max("newest")).head()[0]
        mark = None if before is None else before - wait
        newest = max((x for x in (before, rows.agg(F.max("_us")).head()[0]) if x is not None), default=None)
        starts = F.transform(F.sequence(F.lit(0), F.lit(window // slide - 1)), lambda j: (whole_division(F.col("_us"), step) - j) * step)
        is_late = lambda start: F.lit(False) if mark is None else start + width <= mark
        late = F.size(F.filter(starts, is_late)).cast("bigint").alias("late_windows")
        rows.select(*batch.columns, late).where("late_windows > 0").write.mode("overwrite").parquet(f"{out}-late/batch={batch_id}")
        spread = rows.select(*keys, *[v.alias(n) for n, v in sums.items()], F.explode(F.filter(starts, lambda s: ~is_late(s))).alias("start"))
        counted = spread.groupBy("start", *keys).agg(*[F.sum(n).alias(n) for n in sums])
        held = _history(spark, f"{out}-open", batch_id, kinds)
        held = held if mark is None else held.where(ends > mark)
        merged = held.unionByName(counted).groupBy("start", *keys).agg(*[F.sum(n).alias(n) for n in sums])
        slot = f"{out}-open/{batch_id % HISTORY_SLOTS}"
        merged.write.mode("overwrite").parquet(slot)
        closed = spark.read.schema(kinds).parquet(slot).where(F.lit(False) if newest is None else ends <= newest - wait)
        ratio = (F.col("errors") / F.col("lines")).alias("error_ratio")
        closed = closed.select(F.timestamp_micros("start").alias("window_start"), *keys, "lines", ratio, "anomalies")
        closed.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        spark.createDataFrame([(newest,)], "newest bigint").write.mode("overwrite").parquet(f"{out}-newest/{batch_id % HISTORY_SLOTS}")
        rows.unpersist()

    writer = df.writeStream.foreachBatch(close).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


class LiveMonitor(StreamingQueryListener):
    """Counters of a running query: its observed metrics of every trigger, added up as they arrive.

    Pass the stream through :meth:`watch` and add the monitor to ``spark.streams``; :meth:`stats` is at any time the row
    that :func:`sievelog.operators.profile.monitor_stats` gives for what was processed so far.
    """

    METRICS = "monitor"

    def __init__(self) -> None:
        self.lines = self.anomalies = self.errors = self.triggers = 0
        self.first: int | None = None
        self.last: int | None = None
        self.ended = threading.Event()

    def watch(self, detected: DataFrame, ts: str = "ts", errors: Column | None = None) -> DataFrame:
        micros = F.unix_micros(F.col(ts))
        return detected.observe(
            self.METRICS,
            F.count(F.lit(1)).alias("lines"),
            F.count_if(F.col("is_anomaly")).alias("anomalies"),
            F.count_if(F.lit(False) if errors is None else errors).alias("errors"),
            F.min(micros).alias("first"),
            F.max(micros).alias("last"),
        )

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.METRICS)
        if seen is None or not seen.lines:
            return
        self.triggers += 1
        self.lines += seen.lines
        self.anomalies += seen.anomalies
        self.errors += seen.errors
        self.first = min(x for x in (self.first, seen.first) if x is not None) if seen.first is not None else self.first
        self.last = max(x for x in (self.last, seen.last) if x is not None) if seen.last is not None else self.last

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def stats(self) -> dict:
        seconds = None if self.first is None else (self.last - self.first) / 1e6
        return {
            "lines_processed": self.lines,
            "anomalies_detected": self.anomalies,
            "errors": self.errors,
            "elapsed_seconds": seconds,
            "lines_per_second": self.lines / seconds if seconds else None,
            "anomaly_rate": self.anomalies / max(self.lines, 1),
        }


DAY = 86_400


def first_in_a_day(
    df: DataFrame, message: str = "message", ts: str = "ts", order: str = "line_no", keep_for: int = DAY
) -> DataFrame:
    """The rows that are scored anew: no equal message was *kept* in the ``keep_for`` seconds before.

    Rows without a time are always kept. Adds ``msg_md5``.
    """
    keyed = df.withColumn("msg_md5", F.md5(F.coalesce(F.col(message), F.lit(""))))
    kept = apply_cooldown(keyed, "msg_md5", ts, order, keep_for)
    return kept.unionByName(keyed.where(F.col(ts).isNull()))


def start_dedup(
    df: DataFrame,
    out: str,
    checkpoint: str,
    message: str = "message",
    ts: str = "ts",
    order: str = "line_no",
    keep_for: int = DAY,
    **trigger,
) -> StreamingQuery:
    """:func:`first_in_a_day` on a stream, to parquet below ``out``.

    Each micro-batch starts from the times at which messages were last kept, left by the batch before; they are
    forgotten ``keep_for`` after the newest time that is not in the future. Rows and history are written to folders
    named by batch, so a replay replaces and never repeats. How files fall into triggers changes nothing as long as
    they arrive in order of time.
    """
    spark = df.sparkSession
    kind = df.schema[ts].dataType.simpleString()

    def keep(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("msg_md5", F.md5(F.coalesce(F.col(message), F.lit("")))).persist()
        past = _history(spark, f"{out}-history", batch_id, f"msg_md5 string, {ts} {kind}")
        kept = apply_cooldown(keyed, "msg_md5", ts, order, keep_for, sent_before=past)
        kept.unionByName(keyed.where(F.col(ts).isNull())).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        # read back, not computed again
        new = spark.read.parquet(f"{out}/batch={batch_id}").select("msg_md5", ts)
        _remember(past.unionByName(new), "msg_md5", ts, keep_for, f"{out}-history", batch_id)
        keyed.unpersist()

    writer = df.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


HISTORY_SLOTS = 3  # the one read, the one written, and one more for a replay


def _history(spark, path: str, batch_id: int, kinds: str | T.StructType) -> DataFrame:
    if batch_id == 0:
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(f"{path}/{(batch_id - 1) % HISTORY_SLOTS}")


def _remember(times: DataFrame, key: str, ts: str, keep_seconds: int, path: str, batch_id: int) -> None:
    """Write the last time of each key. A time in the future does not age the others."""
    last = times.groupBy(key).agg(F.max(ts).alias(ts)).where(F.col(ts).isNotNull())
    newest = last.where(F.col(ts) <= F.current_timestamp()).agg(F.max(ts)).scalar()
    old = F.col(ts) < newest - F.make_dt_interval(secs=F.lit(keep_seconds))
    last.where(~F.coalesce(old, F.lit(False))).write.mode("overwrite").parquet(f"{path}/{batch_id % HISTORY_SLOTS}")


KEEP_STATE_SECONDS = 3600


def _walk(keep_seconds: int):
    """State function: walk a bucket's new alerts in time order, remembering when each identity was last sent."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(batches), ignore_index=True)
        ids, t, wait = rows["id"].to_numpy(), rows["t"].to_numpy(), rows["wait"].to_numpy()
        going = []
        for i in np.lexsort((rows["line_no"].to_numpy(), t)):
            before = last.get(ids[i])
            if before is None or t[i] - before >= wait[i]:
                last[ids[i]] = int(t[i])
                going.append(i)
        watermark = state.getCurrentWatermarkMs()
        horizon = (watermark - keep_seconds * 1000) * 1000
        last = {k: v for k, v in last.items() if v >= horizon}
        if last:
            state.update((list(last), list(last.values())))
            expiry = max(last.values()) // 1000 + keep_seconds * 1000
            state.setTimeoutTimestamp(max(expiry, watermark + 1))
        elif state.exists:
            state.remove()
        if going:
            yield rows.loc[going, ["id", "line_no", "t"]]

    return step


def stream_cooldown(
    matched: DataFrame,
    delay: str = "1 hour",
    ts: str = "ts",
    order: str = "line_no",
    keep_seconds: int = KEEP_STATE_SECONDS,
    buckets: int = 256,
) -> DataFrame:
    """Alerts past the cooldown of their identity, as a stream: ``(id, line_no, ts)`` of those sent.

    ``matched`` is a stream of :func:`match_rules`. Identities share state by hash bucket, so a trigger calls
    Python once per bucket and not once per identity. A time is dropped once the watermark is ``keep_seconds``
    past it (identities carry the hour; never set it below the longest cooldown). The rows of a trigger, and so
    of a bucket, are bounded by the source's rate limit; :func:`start_alerting` needs no such bound.
    """
    narrow = (
        matched.where("deliverable")
        .withWatermark(ts, delay)
        .select(
            F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"),
            "id",
            F.col(order).alias("line_no"),
            F.col(ts),
            F.unix_micros(F.col(ts)).alias("t"),
            (F.col("cooldown").cast("bigint") * 1_000_000).alias("wait"),
        )
    )
    sent = narrow.groupBy("bucket").applyInPandasWithState(
        _walk(keep_seconds),
        "id string, line_no bigint, t bigint",
        "ids array<string>, last array<bigint>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return sent.select("id", "line_no", F.timestamp_micros("t").alias("ts"))


class LastSent(StatefulProcessor):
    """State of a bucket of identities: for each, under its own key, when it was last sent.

    Only the identities of a trigger are read and written. A timer per bucket and ``keep_seconds`` of event time forgets
    those whose time is that long ago.
    """

    def __init__(self, keep_seconds: int):
        self.keep_ms = keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getMapState("last_sent", "id string", "t bigint")

    def _timer(self, latest: int, watermark: int) -> None:
        # on whole multiples of the time kept, so a bucket's keys are gone through once in that time
        due = max(latest // 1000 + self.keep_ms, watermark + 1)
        self._handle.registerTimer(-(-due // max(self.keep_ms, 1)) * max(self.keep_ms, 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.iloc[np.lexsort((frame["line_no"].to_numpy(), frame["t"].to_numpy()))]
        known = self._last.exists()
        last, changed, going = {}, set(), []
        for i, (who, t, wait) in enumerate(zip(frame["id"].tolist(), frame["t"].tolist(), frame["wait"].tolist())):
            if who not in last:
                before = self._last.getValue((who,)) if known else None
                last[who] = before[0] if before else None
            # what has no cooldown goes in any case
            goes = last[who] is None or t - last[who] >= (wait if wait > 0 else 1)
            if goes:
                last[who] = t
                changed.add(who)
            if goes or wait <= 0:
                going.append(i)
        for who in changed:
            self._last.updateValue((who,), (last[who],))
        if changed:
            self._timer(max(last[who] for who in changed), timerValues.getCurrentWatermarkInMs())
        if going:
            yield frame.iloc[going][["id", "line_no", "t"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        old, latest = [], None
        for who, (t,) in self._last.iterator():
            if t // 1000 + self.keep_ms <= watermark:
                old.append(who)
            else:
                latest = t if latest is None else max(latest, t)
        if latest is None:
            self._last.clear()
        else:
            for who in old:
                self._last.removeKey(who)
            self._timer(latest, watermark)
        return iter(())


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_cooldown_keyed(
    matched: DataFrame,
    delay: str = "1 hour",
    ts: str = "ts",
    order: str = "line_no",
    keep_seconds: int = KEEP_STATE_SECONDS,
    buckets: int = 256,
) -> DataFrame:
    """:func:`stream_cooldown` with a value for each identity in a state store on disk, which this sets for the session.

    State is as large as the disks allow and a trigger touches only its own identities, each with a call to the store to
    read it, if its bucket is known, and one to write it. Python is entered per hash bucket of identities and not per
    identity. A value is forgotten once the watermark is ``keep_seconds`` past it, up to as long again later (identities
    carry the hour; never set it below the longest cooldown). A bucket's rows of one trigger are walked together and are
    bounded by the source's rate limit; :func:`start_alerting` needs no such bound.
    """
    spark = matched.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)
    ship_package(spark)
    narrow = (
        matched.where("deliverable")
        .withWatermark(ts, delay)
        .select(
            F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"),
            "id",
            F.col(order).alias("line_no"),
            F.col(ts),
            F.unix_micros(F.col(ts)).alias("t"),
            (F.col("cooldown").cast("bigint") * 1_000_000).alias("wait"),
        )
    )
    kind = T.StructType([narrow.schema["id"], narrow.schema["line_no"]]).add("t", "long")
    sent = narrow.groupBy("bucket").transformWithStateInPandas(LastSent(keep_seconds), kind, "append", "eventTime")
    return sent.select("id", "line_no", F.timestamp_micros("t").alias("ts"))


def detect_stream(
    lines: DataFrame,
    scorer: Scorer,
    column: str = "value",
    threshold: float = DEFAULT_THRESHOLD,
    ingest_ts: Column | None = None,
    default_year: int | None = None,
) -> DataFrame:
    """Lines to detection results, one stateless plan.

    Syslog times carry no year. A stream reads them in ``default_year``, the current one if not given: a year
    before the watermark's start would make every such row late.
    """
    year = datetime.date.today().year if default_year is None else default_year
    parsed = parse_logs(lines, column, ingest_ts=ingest_ts, default_year=year)
    return detect(parsed, scorer, threshold)


def alert_stream(detected: DataFrame, config: AlertConfig, keep: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Detection results to matched alerts, ready for :func:`stream_cooldown`."""
    return match_rules(create_alerts(detected, keep=keep), config)


def start_alerting(
    detected: DataFrame,
    config: AlertConfig,
    outbox: str,
    checkpoint: str,
    history: str | None = None,
    keep_seconds: int = 2 * KEEP_STATE_SECONDS,
    **trigger,
) -> StreamingQuery:
    """Detection stream to outbox: alert, match, cool down, route, render, append.

    Each micro-batch runs the batch cooldown, started from the table of last sent times that the batch before
    it left; that needs no Python per identity, and an identity filling a third of a batch is no one task's
    work. Outbox and history are written to folders named by batch, so a replay replaces and never repeats.
    Times older than ``keep_seconds`` before the newest that is not in the future are forgotten: identities carry
    the hour, and one alert dated ahead leaves the others' history alone.
    """
    spark = detected.sparkSession
    history = history or f"{outbox.rstrip('/')}-history"
    numbered = "line_no" in detected.columns

    def deliver(batch: DataFrame, batch_id: int) -> None:
        # rows of a followed folder carry no number; inside a micro-batch any unique one will do
        rows = batch if numbered else batch.withColumn("line_no", F.monotonically_increasing_id())
        alerts = rows.persist()
        past = _history(spark, history, batch_id, "id string, ts timestamp")
        sent = apply_cooldown(alerts, "id", "ts", "line_no", "cooldown", sent_before=past).persist()
        append_outbox(payloads(route(sent, config), config), outbox, batch_id)
        _remember(past.unionByName(sent.select("id", "ts")), "id", "ts", keep_seconds, history, batch_id)
        sent.unpersist()
        alerts.unpersist()

    return (
        alert_stream(detected, config, ("line_no",) if numbered else ())
        .where("deliverable")
        .writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def run_to_table(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and read back what it wrote, through the shared folder."""
    spark = df.sparkSession
    out, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(out)
    else:

        def replace(batch: DataFrame, batch_id: int) -> None:
            # a complete-mode batch is the whole result: the newest one stands
            batch.write.mode("overwrite").parquet(out)

        query = writer.outputMode(mode).foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)

