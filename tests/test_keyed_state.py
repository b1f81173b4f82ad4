"""Keyed cooldown state: one call of Python for a bucket of identities, a value for each of them."""

import datetime as dt

import pandas as pd

from sievelog.operators.cooldown import apply_cooldown
from sievelog.streaming import streams as st

from tests.test_windows import ALERTS, START, _triggers


class _Map(dict):
    reads = 0

    def exists(self):
        return bool(self)

    def getValue(self, key):
        self.reads += 1
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


class _Handle:
    def __init__(self):
        self.map, self.timers = _Map(), []

    def getMapState(self, *_):
        return self.map

    def registerTimer(self, at):
        self.timers.append(at)


class _Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _frame(rows):
    return iter([pd.DataFrame(rows, columns=["id", "line_no", "t", "wait"])])


def test_a_bucket_walks_many_identities_and_reads_only_those_it_meets():
    handle, keeper = _Handle(), st.LastSent(100)
    keeper.init(handle)
    second = 1_000_000
    first = [(f"i{k}", k, k * second, 10 * second) for k in range(50)] + [(f"i{k}", 100 + k, (k + 5) * second, 10 * second) for k in range(50)]
    out = pd.concat(keeper.handleInputRows((0,), _frame(first), _Times(0)))
    assert sorted(out["line_no"]) == list(range(50)) and handle.map.reads == 0 and len(handle.timers) == 1
    again = [("i3", 200, 12 * second, 10 * second), ("i4", 201, 14 * second, 10 * second), ("new", 202, second, 0), ("new", 203, second, 0)]
    out = pd.concat(keeper.handleInputRows((0,), _frame(again), _Times(0)))
    assert sorted(out["line_no"]) == [201, 202, 203] and handle.map.reads == 3
    # at 120 s those sent by the twentieth second go, the others stay and have a timer of their own
    before = len(handle.timers)
    list(keeper.handleExpiredTimer((0,), _Times(120_000), None))
    assert ("i20",) not in handle.map and ("i21",) in handle.map and len(handle.timers) == before + 1 and handle.timers[-1] > 120_000


def test_many_identities_over_triggers_equal_batch(spark, tmp_path):
    rows = [(None if k % 97 == 0 else f"i{k * 7919 % 400}", k, START + dt.timedelta(seconds=k // 2), (0, 30, 300)[k % 3], k % 11 > 0) for k in range(2400)]
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def start(stream):
        sent = st.stream_cooldown_keyed(stream.where("id is not null"), delay="1 minute", keep_seconds=300, buckets=8)
        return sent.writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)

    _triggers(spark, tmp_path / "in", [rows[:800], rows[800:1600], rows[1600:]], ALERTS, start)
    batch = apply_cooldown(spark.createDataFrame(rows, ALERTS).where("deliverable"))
    found = sorted(r.line_no for r in spark.read.parquet(out).collect())
    assert found == sorted(r.line_no for r in batch.collect()) and len(found) > 500
