"""Anomaly scores, severities and detection results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

DEFAULT_THRESHOLD = 0.7

# fixed values: lowest score of each severity, from the top
SEVERITIES = ((0.9, "critical"), (0.7, "high"), (0.5, "medium"))

Scorer = str | Column | PipelineModel | Callable[[], Callable]


def softmax_score(normal: Column, anomaly: Column) -> Column:
    """Probability of the second of two logits; the larger one is taken out so neither overflows."""
    top = F.greatest(normal, anomaly)
    a, n = F.exp(anomaly - top), F.exp(normal - top)
    return a / (a + n)


def argmax_class(normal: Column, anomaly: Column) -> Column:
    return (anomaly > normal).cast("int")


def severity(score: Column) -> Column:
    out = F
    for lowest, name in SEVERITIES:
        out = out.when(score >= lowest, name)
    return out.otherwise("low")


def confidence(score: Column) -> Column:
    return F.greatest(score, 1 - score)


def with_score(df: DataFrame, scorer: Scorer, message: str = "message", batch_size: int = 256) -> DataFrame:
    """Add ``anomaly_score``.

    ``scorer`` is a column (or its name), a fitted pipeline with a ``probability`` output, or a factory that
    loads a batch scoring function once per Python worker.
    """
    if isinstance(scorer, str):
        return df.withColumn("anomaly_score", F.col(scorer).cast("double"))
    if isinstance(scorer, Column):
        return df.withColumn("anomaly_score", scorer.cast("double"))
    if isinstance(scorer, PipelineModel):
        scored = scorer.transform(df.withColumn("message", F.col(message)))
        score = vector_to_array(F.col("probability"))[1]
        return scored.withColumn("anomaly_score", score).select(*df.columns, "anomaly_score")
    predict = predict_batch_udf(scorer, return_type=T.DoubleType(), batch_size=batch_size)
    return df.withColumn("anomaly_score", predict(F.col(message)))


def score_logs(
    df: DataFrame, scorer: Scorer, threshold: float = DEFAULT_THRESHOLD, message: str = "message"
) -> DataFrame:
    """Add score, prediction (strictly above the threshold), confidence and the threshold itself."""
    score = F.col("anomaly_score")
    return with_score(df, scorer, message).withColumns(
        {
            "is_anomaly": score > threshold,
            "confidence": confidence(score),
            "threshold": F.lit(float(threshold)),
        }
    )


def detect(
    df: DataFrame, scorer: Scorer, threshold: float = DEFAULT_THRESHOLD, message: str = "message"
) -> DataFrame:
    """Detection results: :func:`score_logs` plus the severity. Works on batch and streaming inputs."""
    return score_logs(df, scorer, threshold, message).withColumn(
        "severity", severity(F.col("anomaly_score"))
    )


def batch_summary(detected: DataFrame) -> DataFrame:
    return detected.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.coalesce(F.sum(F.col("is_anomaly").cast("bigint")), F.lit(0)).alias("anomalies_detected"),
    )


def classifier_pipeline(
    message: str = "message", label: str = "label", features: int = 1 << 16, weight: str | None = None
) -> Pipeline:
    """Words that occur, hashed, weighted, scaled to unit length and fed to a logistic regression that keeps few of them.

    Counts and unscaled lengths would let long texts outweigh all others, and many weights fit the training texts only.
    """
    regression = LogisticRegression(featuresCol="_features", labelCol=label, maxIter=50, regParam=0.01, elasticNetParam=1.0)
    if weight:
        regression.setWeightCol(weight)
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, coalesce({message}, '') AS _text FROM __THIS__"),
            RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\W+", minTokenLength=2),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features, binary=True),
            IDF(inputCol="_tf", outputCol="_weighted"),
            Normalizer(inputCol="_weighted", outputCol="_features"),
            regression,
        ]
    )


def train_classifier(
    train: DataFrame, message: str = "message", label: str = "label", balanced: bool = False
) -> PipelineModel:
    """A fitted classifier; ``balanced`` weighs both classes alike, whatever their numbers."""
    if not balanced:
        return classifier_pipeline(message, label).fit(train)
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos")).head()
    share = counts["pos"] / max(counts["n"], 1)
    weight = F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))
    return classifier_pipeline(message, label, weight="_weight").fit(train.withColumn("_weight", weight))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
