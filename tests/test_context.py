import datetime as dt
import random

import numpy as np
import pytest

from sievelog.operators.context import CONTEXT_COLUMNS, context_features

SCHEMA = "file string, line_no bigint, ts timestamp, level string, source string, message string"


def _brute(entries, i):
    """The neighbourhood features of entry ``i`` of one file, straight from their definition."""
    near = entries[max(0, i - 5) : i + 6]
    out = dict.fromkeys(CONTEXT_COLUMNS)
    if len(near) < 2:
        return out
    times = [e[2] for e in near if e[2]]
    if len(times) > 1:
        gaps = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
        out["avg_time_delta"], out["std_time_delta"] = np.mean(gaps), np.std(gaps)
        out["max_time_delta"] = max(gaps)
    out["error_ratio_in_window"] = sum(e[3] == "ERROR" for e in near) / len(near)
    out["warn_ratio_in_window"] = sum(e[3] == "WARN" for e in near) / len(near)
    out["unique_sources_in_window"] = len({e[4] for e in near})
    mine = set(entries[i][5].lower().split())
    sims = []
    for e in near:
        if e[2:] != entries[i][2:]:
            theirs = set(e[5].lower().split())
            if mine or theirs:
                sims.append(len(mine & theirs) / len(mine | theirs))
    if sims:
        out["avg_similarity_in_window"], out["max_similarity_in_window"] = np.mean(sims), max(sims)
    return out


def _entries(seed):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    vocabulary = ["login", "failed", "OK", "disk", "full", "Ünï", ""]
    files = {"big": 120, "one": 1, "two": 2}
    out = []
    for name, n in files.items():
        at, position = start, 0
        for _ in range(n):
            # times run backwards now and then, and some are absent
            at += dt.timedelta(microseconds=rnd.randint(-2_000_000, 9_000_000))
            position += rnd.choice([1, 1, 5, 300])
            out.append(
                (
                    name,
                    position,
                    at if rnd.random() > 0.15 else None,
                    rnd.choice(["ERROR", "WARN", "WARNING", "INFO", None]),
                    rnd.choice(["a", "b", None]),
                    " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 3))),
                )
            )
            if rnd.random() < 0.1:
                position += 1
                out.append((name, position, *out[-1][2:]))
    return out


@pytest.mark.parametrize("rows_per_cell", [2, 40, 100_000])
def test_against_definition(spark, rows_per_cell):
    entries = _entries(3)
    df = spark.createDataFrame(entries, SCHEMA)
    found = {(r["file"], r["line_no"]): r for r in context_features(df, rows_per_cell=rows_per_cell).collect()}
    assert len(found) == len(entries)
    for name in {e[0] for e in entries}:
        own = [e for e in entries if e[0] == name]
        for i, e in enumerate(own):
            got, want = found[name, e[1]], _brute(own, i)
            for c in CONTEXT_COLUMNS:
                if want[c] is None:
                    assert got[c] is None, (e, c)
                else:
                    assert got[c] == pytest.approx(want[c], abs=1e-9), (e, c)
