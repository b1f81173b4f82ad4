import random

import pytest
from pyspark.sql import functions as F

from sievelog.operators import evaluate as ev
from sievelog.operators.scoring import argmax_class, batch_summary, detect, score_logs, softmax_score


def _df(spark, rows):
    return spark.createDataFrame(
        [(i, y, int(s > 0.5), s) for i, (y, s) in enumerate(rows)],
        "id bigint, label int, prediction int, anomaly_score double",
    )


def _auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def _ap(rows):
    total = sum(y for y, _ in rows)
    out = before = 0.0
    for cut in sorted({s for _, s in rows}, reverse=True):
        chosen = [y for y, s in rows if s >= cut]
        recall = sum(chosen) / total if total else 0
        out += (recall - before) * sum(chosen) / len(chosen)
        before = recall
    return out


CASES = {
    "perfect": [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)],
    "tied": [(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)],
    "no positives": [(0, 0.9), (0, 0.1)],
    "no negatives": [(1, 0.9), (1, 0.1)],
    "mixed": [(random.Random(i).randint(0, 1), random.Random(-i).randint(0, 20) / 20) for i in range(1, 200)],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("rows_per_cell", [2, 10_000])
def test_curves(spark, name, rows_per_cell):
    rows = CASES[name]
    df = _df(spark, rows)
    auc = ev.roc_auc(df, rows_per_cell=rows_per_cell).head()[0]
    assert auc == (None if _auc(rows) is None else pytest.approx(_auc(rows)))
    assert ev.average_precision(df, rows_per_cell=rows_per_cell).head()[0] == pytest.approx(_ap(rows))


def test_empty_denominators(spark):
    row = ev.binary_metrics(_df(spark, [(0, 0.1), (0, 0.2)])).head()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (1.0, 0.0, 0.0, 0.0)
    assert ev.binary_metrics(_df(spark, []).where("false")).head()["accuracy"] == 0.0


@pytest.mark.parametrize("n_pos, n_neg", [(20, 80), (1, 9), (3, 1000), (0, 10)])
def test_split_is_exact_in_each_class(spark, n_pos, n_neg):
    rows = [(1, 0.5)] * n_pos + [(0, 0.5)] * n_neg
    split = ev.stratified_split(_df(spark, rows), "id", hash_digits=1)
    found = {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()}
    for label, n in ((1, n_pos), (0, n_neg)):
        test = -(-n * 2 // 10)
        assert found.get((label, "test"), 0) == test
        assert sum(v for (y, _), v in found.items() if y == label) == n
    again = ev.stratified_split(_df(spark, rows).repartition(7), "id", hash_digits=3)
    assert sorted(split.select("id", "split").collect()) == sorted(again.select("id", "split").collect())


def test_scores(spark):
    df = spark.createDataFrame([(0, 800.0, -800.0), (1, 1.0, 1.0), (2, -5.0, 700.0)], "i int, a double, b double")
    rows = df.select(softmax_score(F.col("a"), F.col("b")).alias("p"), argmax_class(F.col("a"), F.col("b")).alias("c"))
    assert [(r["p"], r["c"]) for r in rows.collect()] == [(0.0, 0), (0.5, 0), (1.0, 1)]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([("m", 0.7), ("m", 0.71)], "message string, s double")
    out = detect(df, "s", 0.7)
    assert [r["is_anomaly"] for r in out.orderBy("s").collect()] == [False, True]
    assert batch_summary(out).head().asDict() == {"total_processed": 2, "anomalies_detected": 1}


def test_callers_batch_scorer(spark):
    def load():
        import numpy as np

        return lambda messages: np.array([min(len(m) / 10, 1.0) for m in messages.ravel()])

    df = spark.createDataFrame([("abc",), ("a" * 20,)], "message string")
    rows = score_logs(df, load, 0.5).orderBy("anomaly_score").collect()
    assert [(r["anomaly_score"], r["is_anomaly"], r["confidence"]) for r in rows] == [(0.3, False, 0.7), (1.0, True, 1.0)]


def test_full_report_equals_the_single_metrics(spark):
    from sievelog.operators import evaluate as ev

    rnd = random.Random(8)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "label int, anomaly_score double").selectExpr("*", "cast(coalesce(anomaly_score, 0) > 0.6 as int) AS prediction")
    report = ev.full_report(df, rows_per_cell=20)
    for name, single in (("binary_metrics", ev.binary_metrics), ("class_report", ev.class_report), ("confusion_matrix", ev.confusion_matrix), ("label_agreement", ev.label_agreement)):
        wanted = single(df)
        assert sorted(map(tuple, report[name].select(wanted.columns).collect())) == sorted(map(tuple, wanted.collect()))
    areas = report["areas"].head()
    assert areas["roc_auc"] == pytest.approx(ev.roc_auc(df).head()[0]) and areas["average_precision"] == pytest.approx(ev.average_precision(df).head()[0])


@pytest.mark.parametrize("rows", [[], [(1, 0.5)], [(0, 0.5)], [(1, None)]])
def test_full_report_of_few_rows(spark, rows):
    from sievelog.operators import evaluate as ev

    df = spark.createDataFrame(rows, "label int, anomaly_score double").selectExpr("*", "1 AS prediction")
    report = ev.full_report(df)
    assert report["binary_metrics"].head()["num_samples"] == len(rows)
    assert report["areas"].head()["roc_auc"] is None
