"""Sentence vectors: encode each distinct message once, then statistics and similarities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, functions as F, types as T

from sievelog.functions.vectors import cosine, norm, with_statistics
from sievelog.operators.lookup import spread_lookup


def hashed_vector(message: Column, dim: int = 64) -> Column:
    """A deterministic stand-in encoder: signed counts of hashed words, scaled to unit length.

    The first eight hex digits of a word's md5 choose its place, the ninth its sign.
    """
    words = F.filter(F.split(F.lower(F.coalesce(message, F.lit(""))), "[\\t-\\r ]+"), lambda w: w != "")
    digests = F.transform(words, lambda w: F.md5(w))
    signed = F.transform(
        digests,
        lambda h: F.struct(
            (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).alias("at"),
            F.when(F.substring(h, 9, 1) < "8", 1.0).otherwise(-1.0).alias("sign"),
        ),
    )

    def counts(pairs: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dim - 1)),
            lambda b: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.when(p["at"] == b, p["sign"]).otherwise(0.0)),
        )

    # bound one after the other, so that nothing is computed again for each element
    summed = F.transform(F.array(signed), counts)
    return F.transform(F.transform(summed, lambda v: F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(
        s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(0.0)
    ))[0]


def message_memo(df: DataFrame, message: str = "message") -> DataFrame:
    """``(message_md5, message)``: each distinct message once, keyed by its hash."""
    return df.select(F.md5(F.col(message)).alias("message_md5"), message).dropDuplicates(["message_md5"])


def encode_messages(
    df: DataFrame,
    key: Sequence[str],
    message: str = "message",
    make_predict: Callable[[], Callable] | None = None,
    out: str = "embedding",
    batch_size: int = 256,
    salts: int | None = None,
) -> DataFrame:
    """Add the vector of each message, running the encoder once per distinct message.

    ``make_predict`` loads the model once per Python worker; without one :func:`hashed_vector` is used. The join back spreads the copies of a message over
    ``salts`` parts by the unique row ``key``, so one message filling a third of the table is not one task's
    work; a vector is only copied to the parts its message occurs in.
    """
    if make_predict is None:
        encode = hashed_vector
    else:
        encode = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    vectors = message_memo(df, message).select("message_md5", encode(F.col(message)).alias(out))
    keyed = df.withColumn("message_md5", F.md5(F.col(message)))
    return spread_lookup(keyed, ["message_md5"], vectors, key, salts=salts).drop("message_md5")


def embedding_stats(df: DataFrame, column: str = "embedding") -> DataFrame:
    return with_statistics(df, column)


def pair_similarity(
    pairs: DataFrame, vectors: DataFrame, left: str, right: str, key: str, column: str = "embedding"
) -> DataFrame:
    """Cosine similarity of the listed pairs: two lookups by key, never all pairs."""
    a = vectors.select(F.col(key).alias(left), F.col(column).alias("_a"))
    b = vectors.select(F.col(key).alias(right), F.col(column).alias("_b"))
    both = spread_lookup(
        spread_lookup(pairs, [left], a, [left, right], "inner"), [right], b, [left, right], "inner"
    )
    return both.withColumn("similarity", cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")
