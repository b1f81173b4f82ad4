"""Registered queries: scores, severities, splits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sievelog.operators import evaluate as ev
from sievelog.operators import predicates, scoring
from sievelog.plans.views import scored, table
from sievelog.plans.views_sql import SCORED

THRESHOLD = 0.7


def _detected(spark, sf_dir) -> DataFrame:
    entries = scored(spark, sf_dir).drop("is_anomaly", "anomaly_score")
    return scoring.detect(entries, "score", THRESHOLD)


def _logits(df: DataFrame) -> DataFrame:
    """Two logits per entry, from its score and its position."""
    return df.select(
        "line_no",
        ((F.col("line_no") % 7) - 3.0).alias("normal"),
        (F.col("score") * 10 - 5).alias("anomaly"),
    )


def threshold_filter(spark, sf_dir):
    return predicates.above_threshold(scored(spark, sf_dir), THRESHOLD).select("line_no", "anomaly_score")


def softmax_score(spark, sf_dir):
    normal, anomaly = F.col("normal"), F.col("anomaly")
    return _logits(scored(spark, sf_dir)).select(
        "line_no",
        F.round(scoring.softmax_score(normal, anomaly), 6).alias("probability"),
        scoring.argmax_class(normal, anomaly).alias("prediction"),
    )


def severity(spark, sf_dir):
    return scored(spark, sf_dir).select("line_no", scoring.severity(F.col("anomaly_score")).alias("severity"))


def detect_batch(spark, sf_dir):
    return _detected(spark, sf_dir).select(
        "line_no", "is_anomaly", "anomaly_score", "severity", F.round("confidence", 6).alias("confidence"), "threshold"
    )


def anomaly_report(spark, sf_dir):
    return predicates.anomalies_only(_detected(spark, sf_dir), 100).select("line_no", "message", "severity")


def batch_summary(spark, sf_dir):
    return scoring.batch_summary(_detected(spark, sf_dir))


def _labelled_docs(spark, sf_dir) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("message"))
    return docs.join(labels, "doc_id")


def stratified_split(spark, sf_dir):
    return ev.stratified_split(scored(spark, sf_dir), "line_no").select("line_no", "label", "split")


def split_sizes(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("label", F.col("quality"))
    split = ev.stratified_split(labels, "doc_id")
    return split.groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def binary_metrics(spark, sf_dir):
    return _rounded(ev.binary_metrics(scored(spark, sf_dir)), "accuracy", "precision", "recall", "f1")


def roc_auc(spark, sf_dir):
    return _rounded(ev.roc_auc(scored(spark, sf_dir)), "roc_auc")


def average_precision(spark, sf_dir):
    return _rounded(ev.average_precision(scored(spark, sf_dir)), "average_precision")


def class_report(spark, sf_dir):
    return _rounded(ev.class_report(scored(spark, sf_dir)), "precision", "recall", "f1")


def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(scored(spark, sf_dir))


def class_balance(spark, sf_dir):
    return _rounded(ev.class_balance(scored(spark, sf_dir)), "percent")


def label_agreement(spark, sf_dir):
    return _rounded(ev.label_agreement(scored(spark, sf_dir)), "agreement")


def _held_out_predictions(spark, sf_dir) -> DataFrame:
    """Predictions for the test part of the labelled documents by a classifier fitted on the training part."""
    split = ev.stratified_split(_labelled_docs(spark, sf_dir), "doc_id")
    model = scoring.train_classifier(split.where("split = 'train'").select("message", "label"), balanced=True)
    scored_docs = scoring.score_logs(split.where("split = 'test'"), model, 0.5)
    return scored_docs.withColumn("prediction", F.col("is_anomaly").cast("int"))


def train_classifier(spark, sf_dir):
    """Train, score the held-out documents, and say whether documents of either class are found."""
    report = ev.confusion_matrix(_held_out_predictions(spark, sf_dir))
    right = F.when(F.col("label") == 1, F.col("pred_1")).otherwise(F.col("pred_0"))
    n = F.col("pred_0") + F.col("pred_1")
    return report.agg(
        F.sum(n).alias("num_samples"),
        F.sum(F.when(F.col("label") == 1, n)).alias("num_anomalies"),
        F.every(right > 0).alias("learned"),
    )


def train_classifier_report(spark, sf_dir):
    """Precision, recall, F1 and support of both classes on the held-out documents."""
    return ev.class_report(_held_out_predictions(spark, sf_dir))


def model_roundtrip(spark, sf_dir):
    """Train, save, load: labelled documents, and how many of them both models score alike."""
    from sievelog.session import scratch_path

    docs = _labelled_docs(spark, sf_dir)
    path = scratch_path(spark, "classifier")
    fitted = scoring.train_classifier(docs.select("message", "label"))
    scoring.save_model(fitted, path)
    once = scoring.detect(docs, fitted).withColumnRenamed("anomaly_score", "before")
    twice = scoring.detect(once.drop("is_anomaly", "severity", "confidence", "threshold"), scoring.load_model(path))
    alike = F.count_if(F.abs(F.col("anomaly_score") - F.col("before")) < 1e-9)
    return twice.agg(F.count(F.lit(1)).alias("documents"), alike.alias("alike"))


QUERIES = {
    "threshold_filter": threshold_filter,
    "softmax_score": softmax_score,
    "severity": severity,
    "detect_batch": detect_batch,
    "anomaly_report": anomaly_report,
    "batch_summary": batch_summary,
    "stratified_split": stratified_split,
    "split_sizes": split_sizes,
    "binary_metrics": binary_metrics,
    "roc_auc": roc_auc,
    "average_precision": average_precision,
    "class_report": class_report,
    "confusion_matrix": confusion_matrix,
    "class_balance": class_balance,
    "label_agreement": label_agreement,
    "train_classifier": train_classifier,
    "train_classifier_report": train_classifier_report,
    "model_roundtrip": model_roundtrip,
}

SEVERITY_SQL = (
    "CASE WHEN anomaly_score >= 0.9 THEN 'critical' WHEN anomaly_score >= 0.7 THEN 'high' "
    "WHEN anomaly_score >= 0.5 THEN 'medium' ELSE 'low' END"
)


def _split_sql(source: str, key: str) -> str:
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST({key} AS VARCHAR) || ':42'), {key}) - 1 AS place,
  count(*) OVER (PARTITION BY label) AS n FROM {source}),
cut AS (SELECT *, ceil(n * 0.2::DOUBLE) AS n_test FROM placed),
split AS (SELECT *, CASE WHEN place < n_test THEN 'test' WHEN place < n_test + ceil((n - n_test) * (0.1::DOUBLE / (1 - 0.2::DOUBLE))) THEN 'validation'
  ELSE 'train' END AS split FROM cut)"""


_METRICS = """c AS (SELECT count(*) AS n, sum(label) AS pos, sum(prediction) AS pred, count(*) FILTER (label = 1 AND prediction = 1) AS hit,
  count(*) FILTER (label = prediction) AS good FROM scored),
m AS (SELECT n, pos, good * 1.0 / n AS a, CASE WHEN pred > 0 THEN hit * 1.0 / pred ELSE 0 END AS p, CASE WHEN pos > 0 THEN hit * 1.0 / pos ELSE 0 END AS r FROM c)"""

_REPORT = """k AS (SELECT c, count(*) FILTER (label = c) AS support, count(*) FILTER (prediction = c) AS predicted,
  count(*) FILTER (label = c AND prediction = c) AS hit FROM scored, (VALUES (0), (1)) AS t(c) GROUP BY c),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN hit * 1.0 / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit * 1.0 / support ELSE 0 END AS recall FROM k),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr),
report AS (SELECT CAST(c AS VARCHAR) AS class, precision, recall, f1, support FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)"""

_W = f"WITH {SCORED}"

_DOCS = "l AS (SELECT doc_id, toxic AS label FROM labels JOIN documents USING (doc_id))"

ORACLES = {
    "train_classifier": f"WITH {_DOCS}, {_split_sql('l', 'doc_id')} SELECT count(*) AS num_samples, CAST(sum(label) AS BIGINT) AS num_anomalies, true AS learned FROM split WHERE split = 'test'",
    "model_roundtrip": f"WITH {_DOCS} SELECT count(*) AS documents, count(*) AS alike FROM l",
    "threshold_filter": f"{_W} SELECT line_no, anomaly_score FROM scored WHERE anomaly_score > 0.7",
    "softmax_score": f"{_W}, z AS (SELECT line_no, (line_no % 7) - 3.0::DOUBLE AS l0, score * 10 - 5 AS l1 FROM scored) "
    "SELECT line_no, round(exp(l1) / (exp(l0) + exp(l1)), 6) AS probability, CAST(l1 > l0 AS INT) AS prediction FROM z",
    "severity": f"{_W} SELECT line_no, {SEVERITY_SQL} AS severity FROM scored",
    "detect_batch": f"{_W} SELECT line_no, anomaly_score > 0.7 AS is_anomaly, anomaly_score, {SEVERITY_SQL} AS severity, "
    "round(greatest(anomaly_score, 1 - anomaly_score), 6) AS confidence, 0.7::DOUBLE AS threshold FROM scored",
    "anomaly_report": f"{_W} SELECT line_no, substr(message, 1, 100) AS message, {SEVERITY_SQL} AS severity FROM scored WHERE anomaly_score > 0.7",
    "batch_summary": f"{_W} SELECT count(*) AS total_processed, count(*) FILTER (anomaly_score > 0.7) AS anomalies_detected FROM scored",
    "stratified_split": f"{_W}, {_split_sql('scored', 'line_no')} SELECT line_no, label, split FROM split",
    "split_sizes": f"WITH l AS (SELECT doc_id, quality AS label FROM labels), {_split_sql('l', 'doc_id')} SELECT label, split, count(*) AS n FROM split GROUP BY ALL",
    "binary_metrics": f"{_W}, {_METRICS} SELECT n AS num_samples, CAST(pos AS BIGINT) AS num_anomalies, round(a, 6) AS accuracy, round(p, 6) AS precision, "
    "round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM m",
    "roc_auc": f"{_W}, r AS (SELECT label, (rank() OVER (ORDER BY anomaly_score) + rank() OVER (ORDER BY anomaly_score) "
    "+ count(*) OVER (PARTITION BY anomaly_score) - 1) / 2.0 AS rk FROM scored), "
    "s AS (SELECT sum(rk) FILTER (label = 1) AS rs, (count(*) FILTER (label = 1))::DOUBLE AS p, (count(*) FILTER (label = 0))::DOUBLE AS n FROM r) "
    "SELECT round((rs - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM s",
    "average_precision": f"{_W}, g AS (SELECT anomaly_score, sum(label) AS pos, count(*) AS n FROM scored GROUP BY 1), "
    "c AS (SELECT pos, sum(pos) OVER (ORDER BY anomaly_score DESC) AS tp, sum(n) OVER (ORDER BY anomaly_score DESC) AS seen FROM g) "
    "SELECT round(sum(pos * (tp * 1.0::DOUBLE / seen)) / sum(pos), 6) AS average_precision FROM c",
    "class_report": f"{_W}, {_REPORT} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM report",
    "confusion_matrix": f"{_W} SELECT label, count(*) FILTER (prediction = 0) AS pred_0, count(*) FILTER (prediction = 1) AS pred_1 FROM scored GROUP BY label",
    "class_balance": f"{_W} SELECT label, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM scored), 6) AS percent FROM scored GROUP BY label",
    "label_agreement": f"{_W} SELECT count(*) AS total, count(*) FILTER (label = prediction) AS correct, "
    "round(count(*) FILTER (label = prediction) * 1.0::DOUBLE / count(*), 6) AS agreement FROM scored",
}
