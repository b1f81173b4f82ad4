import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from sievelog.operators.cooldown import Cell, apply_cooldown, composed

BASE = 1_700_000_000


def _df(spark, rows):
    """rows: (id, seconds, cooldown)"""
    data = [(k, (BASE + t) * 1_000_000, c, i) for i, (k, t, c) in enumerate(rows)]
    df = spark.createDataFrame(data, "id string, t bigint, cooldown int, line_no bigint")
    return df.selectExpr("id", "timestamp_micros(t) AS ts", "cooldown", "line_no")


def _walk(rows):
    last, kept = {}, []
    for i, (k, t, c) in sorted(enumerate(rows), key=lambda x: (x[1][1], x[0])):
        if k not in last or t - last[k] >= c:
            last[k] = t
            kept.append(i)
    return sorted(kept)


def _kept(spark, rows, **options):
    return sorted(r["line_no"] for r in apply_cooldown(_df(spark, rows), **options).collect())


@pytest.mark.parametrize("cell", [1, 3, 1000])
def test_counts_from_the_last_sent(spark, cell):
    rows = [("a", t, 300) for t in (0, 100, 200, 300, 400, 700)]
    assert _kept(spark, rows, rows_per_cell=cell) == [0, 3, 5]


@pytest.mark.parametrize("cell", [1, 1000])
def test_edges(spark, cell):
    rows = [("a", 0, 300), ("a", 299, 300), ("b", 0, 300), ("b", 300, 300), ("c", 5, 300), ("c", 5, 300)]
    assert _kept(spark, rows, rows_per_cell=cell) == [0, 2, 3, 4]


@pytest.mark.parametrize("cell", [1, 5, 1000])
def test_mixed_cooldowns_ties_and_none(spark, cell):
    rnd = random.Random(cell)
    rows = [("hot", rnd.randint(0, 60), rnd.choice([0, 5, 9, 30])) for _ in range(120)]
    rows += [(rnd.choice("xyz"), rnd.randint(0, 60), rnd.choice([5, 30])) for _ in range(40)]
    assert _kept(spark, rows, rows_per_cell=cell) == _walk(rows)


@settings(max_examples=3, deadline=None)
@given(
    st.lists(
        st.tuples(st.sampled_from("ab"), st.integers(0, 200), st.sampled_from([10, 40])), min_size=1, max_size=60
    )
)
def test_any_sequence(spark, rows):
    expected = _walk(rows)
    assert _kept(spark, rows) == expected
    assert _kept(spark, rows, rows_per_cell=4) == expected


@pytest.mark.parametrize("cell", [1, 1000])
def test_continues_from_an_earlier_run(spark, cell):
    rnd = random.Random(9)
    rows = sorted(((rnd.choice("ab"), rnd.randint(0, 300), rnd.choice([0, 7, 20])) for _ in range(120)), key=lambda r: r[1])
    whole = _walk(rows)
    first, second = rows[:60], rows[60:]
    kept = _kept(spark, first, rows_per_cell=cell)
    last = {}
    for i in kept:
        last[first[i][0]] = max(last.get(first[i][0], 0), first[i][1])
    past = spark.createDataFrame([(k, (BASE + t) * 1_000_000) for k, t in last.items()], "id string, t bigint")
    past = past.selectExpr("id", "timestamp_micros(t) AS ts")
    kept += [i + 60 for i in _kept(spark, second, rows_per_cell=cell, sent_before=past)]
    assert kept == whole


@pytest.mark.parametrize("cell", [1, 1000])
def test_late_alerts_stay_held_back(spark, cell):
    past = _df(spark, [("a", 100, 0)]).select("id", "ts")
    rows = [("a", 40, 30), ("a", 99, 30), ("a", 129, 30), ("a", 130, 30), ("b", 0, 30)]
    assert _kept(spark, rows, rows_per_cell=cell, sent_before=past) == [3, 4]


@pytest.mark.parametrize("cell", [1, 1000])
def test_rows_numbered_by_file_and_line(spark, cell):
    rows = [("a", t, 300) for t in (0, 100, 200, 300, 400, 700)]
    df = _df(spark, rows).selectExpr("id", "ts", "cooldown", "named_struct('file', 'f', 'line', line_no) AS at")
    kept = apply_cooldown(df, order="at", rows_per_cell=cell).collect()
    assert sorted(r["at"]["line"] for r in kept) == [0, 3, 5]


steps = st.lists(st.tuples(st.integers(1, 60), st.integers(0, 25)), min_size=1, max_size=50, unique=True)


def _cells(rows, cuts):
    """Cells of rows in order, cut where a time begins."""
    rows = sorted(rows)
    parts = [[r for r in rows if a <= r[0] < b] for a, b in zip([0, *cuts], [*cuts, 1000])]
    return [Cell(*np.array(part, np.int64).T) for part in parts if part]


def _all(cells):
    whole = cells[0].exits()
    for cell in cells[1:]:
        whole = composed(*whole, *cell.exits(), int(cells[0].t[0]))
    return whole


def _last(cell, last):
    sent = cell.sent(last)
    return max(last, int(cell.t[sent[-1]])) if sent else last


def _entered(map_, last):
    bounds, times = map_
    at = int(np.searchsorted(bounds, last))
    return int(times[at]) if at < len(bounds) else last


@settings(max_examples=300, deadline=None)
@given(steps, st.lists(st.integers(1, 60), max_size=4, unique=True))
def test_maps_of_cells_and_of_their_compositions(rows, cuts):
    cells = _cells(rows, sorted(cuts))
    whole = _all(cells)
    for start in range(-30, int(cells[0].t[0])):
        last = start
        for cell in cells:
            assert _entered(cell.exits(), last) == _last(cell, last)
            last = _last(cell, last)
        assert _entered(whole, start) == last


def test_a_map_is_no_longer_than_a_cooldown_has_alerts():
    cells = [Cell(np.arange(k * 1000, (k + 1) * 1000), np.full(1000, 7)) for k in range(5)]
    assert len(cells[3].exits()[0]) <= 8 and len(_all(cells)[0]) <= 8


def test_jobs_do_not_grow_with_the_alerts_sent(spark):
    def jobs(cooldown):
        rows = [("a", t, cooldown) for t in range(2000)]
        group = f"cooldown-{cooldown}"
        spark.sparkContext.setJobGroup(group, group)
        kept = _kept(spark, rows, rows_per_cell=50)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return kept, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    (few, a), (many, b) = jobs(500), jobs(2)
    assert few == list(range(0, 2000, 500)) and many == list(range(0, 2000, 2))
    assert b <= a + 5
