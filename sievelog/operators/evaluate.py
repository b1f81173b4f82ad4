"""Splits and metrics of binary predictions.

Labels and predictions are 0/1 integers. Curve metrics are cumulative sums over the distinct scores: rows are
first combined per score, and the running sums are taken cell by cell, so neither many ties nor many distinct
scores end on one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievelog.operators.ordered import ROWS_PER_CELL, Running, add_quantile_cells, positions, running
from sievelog.session import written


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; 0 where a denominator is empty."""
    y, p = F.col(label), F.col(prediction)
    counts = df.agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.coalesce(F.sum(y), F.lit(0)).alias("num_anomalies"),
        F.coalesce(F.sum(p), F.lit(0)).alias("_predicted"),
        F.count_if((y == 1) & (p == 1)).alias("_hit"),
        F.count_if(y == p).alias("_right"),
    )
    scored = counts.withColumns(
        {
            "accuracy": _share(F.col("_right"), F.col("num_samples")),
            "precision": _share(F.col("_hit"), F.col("_predicted")),
            "recall": _share(F.col("_hit"), F.col("num_anomalies")),
        }
    )
    return scored.withColumn("f1", _f1(F.col("precision"), F.col("recall"))).drop(
        "_predicted", "_hit", "_right"
    )


def _score_curve(df: DataFrame, label: str, score: str, descending: bool, rows_per_cell: int) -> DataFrame:
    """One row per distinct score with its positives and negatives and the sums over the scores before it."""
    per_score = (
        df.where(F.col(score).isNotNull())
        .groupBy(F.col(score).alias("score"))
        .agg(
            F.sum(F.col(label)).cast("bigint").alias("pos"),
            F.sum(1 - F.col(label)).cast("bigint").alias("neg"),
        )
    )
    # negated scores turn the descending walk into an ascending one
    per_score = per_score.withColumn("at", -F.col("score") if descending else F.col("score"))
    celled = add_quantile_cells(per_score, F.col("at"), rows_per_cell)
    return running(
        celled,
        [],
        [F.col("at")],
        F.col("cell"),
        {
            "pos_before": Running("sum", F.col("pos"), inclusive=False),
            "neg_before": Running("sum", F.col("neg"), inclusive=False),
        },
    ).fillna(0, ["pos_before", "neg_before"])


def roc_auc(
    df: DataFrame, label: str = "label", score: str = "anomaly_score", rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Share of positive/negative pairs ranked the right way round, ties counting half; null without both."""
    curve = _score_curve(df, label, score, False, rows_per_cell)
    won = F.sum(
        F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2)
    )
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return curve.agg(F.when(pos * neg > 0, won / (pos * neg)).alias("roc_auc"))


def average_precision(
    df: DataFrame, label: str = "label", score: str = "anomaly_score", rows_per_cell: int = ROWS_PER_CELL
) -> DataFrame:
    """Step sum of precision over recall, from the highest score down; 0 without positives."""
    curve = _score_curve(df, label, score, True, rows_per_cell)
    seen_pos = F.col("pos_before") + F.col("pos")
    seen = seen_pos + F.col("neg_before") + F.col("neg")
    steps = F.sum(F.col("pos") * seen_pos / seen)
    return curve.agg(
        F.coalesce(F.when(F.sum("pos") > 0, steps / F.sum("pos")), F.lit(0.0)).alias("average_precision")
    )


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per label that occurs, with the counts predicted 0 and 1."""
    counted = df.groupBy(F.col(label).alias("label")).agg(
        F.count_if(F.col(prediction) == 0).alias("pred_0"),
        F.count_if(F.col(prediction) == 1).alias("pred_1"),
    )
    return counted


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then their macro and weighted averages."""
    y, p = F.col(label), F.col(prediction)
    # each row counts towards its label and towards its prediction
    sides = F.array(
        F.struct(y.alias("c"), F.lit(1).alias("is_label"), F.lit(0).alias("is_pred"), (y == p).cast("int").alias("hit")),
        F.struct(p.alias("c"), F.lit(0).alias("is_label"), F.lit(1).alias("is_pred"), F.lit(0).alias("hit")),
    )
    per_class = (
        df.select(F.explode(sides).alias("s"))
        .groupBy(F.col("s.c").alias("c"))
        .agg(
            F.sum("s.hit").alias("hit"),
            F.sum("s.is_label").alias("support"),
            F.sum("s.is_pred").alias("predicted"),
        )
    )
    return _report(per_class)


def _report(per_class: DataFrame) -> DataFrame:
    """Rates of the classes, from their hits, support and predictions, and the averages."""
    rates = {"precision": _share(F.col("hit"), F.col("predicted")), "recall": _share(F.col("hit"), F.col("support"))}
    per_class = per_class.withColumns(rates).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    metrics = ("precision", "recall", "f1")
    total = F.sum("support")
    classes = per_class.select(F.col("c").cast("string").alias("class"), *metrics, "support")
    macro = per_class.agg(
        *[F.avg(m).alias(m) for m in metrics], total.alias("support")
    ).select(F.lit("macro avg").alias("class"), *metrics, "support")
    weighted = per_class.agg(
        *[_share(F.sum(F.col(m) * F.col("support")), total).alias(m) for m in metrics],
        total.alias("support"),
    ).select(F.lit("weighted avg").alias("class"), *metrics, "support")
    return classes.unionByName(macro).unionByName(weighted)


def full_report(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    score: str = "anomaly_score",
    rows_per_cell: int = ROWS_PER_CELL,
) -> dict[str, DataFrame]:
    """All metrics of scored predictions by section, from one pass over the rows.

    The rows are combined into a curve, counts of each label and prediction per distinct score. Everything follows from
    it: the scalars, the report by class and the matrix from its sums, and both areas from one ascending walk over it,
    since what lies above a score is the whole less what lies below. Rows without a score count in all but the areas.
    """
    y, p = F.col(label), F.col(prediction)
    cells = {f"n{a}{b}": F.count_if((y == a) & (p == b)) for a in (0, 1) for b in (0, 1)}
    curve = df.groupBy(F.col(score).cast("double").alias("at")).agg(*[c.alias(n) for n, c in cells.items()])
    curve = written(curve, "curve")
    scored = curve.where("at is not null").select("at", (F.col("n10") + F.col("n11")).alias("pos"), (F.col("n00") + F.col("n01")).alias("neg"))
    before = {f"{x}_before": Running("sum", F.col(x), inclusive=False) for x in ("pos", "neg")}
    walked = running(add_quantile_cells(scored, F.col("at"), rows_per_cell), [], [F.col("at")], F.col("cell"), before)
    walked = walked.fillna(0, list(before))
    both = scored.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("pos", "neg")]).head()
    pos, neg = (F.lit(float(both[x])) for x in ("pos", "neg"))
    reached = pos - F.col("pos_before")
    areas = walked.agg(
        F.when(pos * neg > 0, F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2)) / (pos * neg)).alias("roc_auc"),
        F.coalesce(F.when(pos > 0, F.sum(F.col("pos") * reached / (reached + neg - F.col("neg_before"))) / pos), F.lit(0.0)).alias("average_precision"),
    )
    # four numbers, each with its label and prediction, stand for all rows
    sums = curve.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in cells])
    four = sums.select(F.explode(F.array(*[F.struct(F.lit(int(n[1])).alias("y"), F.lit(int(n[2])).alias("p"), F.col(n).alias("n")) for n in cells])).alias("c"))
    four = four.select("c.*").where("n > 0")
    total, right = F.sum("n"), F.coalesce(F.sum(F.when(F.col("y") == F.col("p"), F.col("n"))), F.lit(0))
    scalars = four.agg(
        F.coalesce(total, F.lit(0)).alias("num_samples"),
        *[F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(n) for n, c in (("num_anomalies", F.col("y") == 1), ("_predicted", F.col("p") == 1), ("_hit", (F.col("y") == 1) & (F.col("p") == 1)))],
        right.alias("_right"),
    ).withColumns(
        {
            "accuracy": _share(F.col("_right"), F.col("num_samples")),
            "precision": _share(F.col("_hit"), F.col("_predicted")),
            "recall": _share(F.col("_hit"), F.col("num_anomalies")),
        }
    )
    scalars = scalars.withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    agreement = scalars.select(F.col("num_samples").alias("total"), F.col("_right").alias("correct"), F.col("accuracy").alias("agreement"))
    matrix = four.groupBy(F.col("y").alias("label")).agg(
        *[F.coalesce(F.sum(F.when(F.col("p") == b, F.col("n"))), F.lit(0)).alias(f"pred_{b}") for b in (0, 1)]
    )
    sides = F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("c"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
    )
    by_class = four.select(F.explode(sides).alias("s")).groupBy(F.col("s.c").alias("c")).agg(*[F.sum(f"s.{x}").alias(x) for x in ("hit", "support", "predicted")])
    return {
        "binary_metrics": scalars.drop("_predicted", "_hit", "_right"),
        "areas": areas,
        "class_report": _report(by_class),
        "confusion_matrix": matrix,
        "label_agreement": agreement,
    }


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percentage of each class."""
    counted = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1))).scalar()
    return counted.select("label", "n", (F.col("n") * 100.0 / total).alias("percent"))


def label_agreement(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    agree = F.count_if(F.col(label) == F.col(prediction))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        agree.alias("correct"),
        _share(agree, F.count(F.lit(1))).alias("agreement"),
    )


def stratified_split(
    df: DataFrame,
    key: str,
    label: str = "label",
    test_size: float = 0.2,
    val_size: float = 0.1,
    seed: int = 42,
    hash_digits: int = 4,
) -> DataFrame:
    """Add ``split``: exact shares of test and validation rows within both classes, the rest for training.

    Rows are ordered by a hash of their key and the seed. The leading hex digits of the hash are the cells, so
    a class with most of the rows is ranked by many tasks.
    """
    positive = F.coalesce(F.col(label).cast("int") == 1, F.lit(False))
    hashed = df.withColumns(
        {
            "_positive": positive,
            "_h": F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))),
        }
    )
    cell = F.conv(F.substring("_h", 1, hash_digits), 16, 10).cast("bigint")
    order: Sequence[Column] = [F.col("_h"), F.col(key)]
    placed = positions(hashed, ["_positive"], order, cell, "_at")
    sizes = df.select(
        F.struct(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    ).scalar()
    placed = placed.withColumn("_sizes", sizes)
    n = F.when(F.col("_positive"), F.col("_sizes.pos")).otherwise(F.col("_sizes.neg"))
    n_test = F.ceil(n * F.lit(test_size))
    n_val = F.ceil((n - n_test) * F.lit(val_size / (1 - test_size)))
    split = (
        F.when(F.col("_at") < n_test, "test")
        .when(F.col("_at") < n_test + n_val, "validation")
        .otherwise("train")
    )
    return placed.withColumn("split", split).drop("_positive", "_h", "_at", "_sizes")
