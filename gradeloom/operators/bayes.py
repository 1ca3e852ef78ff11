"""Multinomial naive Bayes in closed form on long features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.operators.scale import bounded, require
from gradeloom.session import written


def fit(features: DataFrame, labels: DataFrame, n_features: DataFrame, n_classes: int, alpha: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Class priors and per-feature log probabilities.

    ``features(sample_id, idx, value)``, ``labels(sample_id, ord)``,
    ``n_features`` a one-row table with column ``n``. Returns
    ``priors(ord, n, log_prior, log_rest)`` and ``weights(idx, w)`` where ``w``
    is an array over the classes 0..n_classes-1 and ``log_rest`` the log
    probability of a feature never seen in the class.
    """
    require(features, "sample_id", "idx", "value"), require(labels, "sample_id", "ord")
    width = n_features.scalar()
    n_docs = labels.agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = features.join(labels, "sample_id").groupBy("ord", "idx").agg(F.sum("value").alias("s"))
    sums = written(sums, "class-sums")  # classes x features; all that follows reads this
    mass = sums.groupBy("ord").agg(F.sum("s").alias("mass"))
    counts = labels.groupBy("ord").agg(F.count(F.lit(1)).alias("n"))
    priors = counts.join(mass, "ord", "left").fillna(0.0, ["mass"])
    denominator = F.col("mass") + F.lit(float(alpha)) * width
    priors = priors.select(
        "ord", "n", F.log(F.col("n") / n_docs).alias("log_prior"), F.log(F.lit(float(alpha)) / denominator).alias("log_rest"),
        denominator.alias("denominator"),
    )
    logs = sums.join(bounded(priors, n_classes), "ord").select(
        "idx", "ord", F.log((F.col("s") + F.lit(float(alpha))) / F.col("denominator")).alias("lp"), "log_rest"
    )
    cell = lambda k: F.max(F.when(F.col("ord") == k, F.col("lp") - F.col("log_rest")))
    weights = logs.groupBy("idx").agg(F.array(*[F.coalesce(cell(k), F.lit(0.0)) for k in range(n_classes)]).alias("w"))
    return priors.drop("denominator"), weights


def predict(samples: DataFrame, features: DataFrame, priors: DataFrame, weights: DataFrame, n_classes: int, max_features: int | None) -> DataFrame:
    """``(sample_id, p)``: class probabilities of every sample.

    Each class starts from the score of a text made only of unseen features;
    known features add their difference to that.
    """
    known = features.join(bounded(weights, max_features), "idx", "left")
    part = lambda k: F.coalesce(F.col("value") * F.get("w", F.lit(k)), F.lit(0.0))
    scores = known.groupBy("sample_id").agg(
        F.sum("value").alias("mass"), *[F.sum(part(k)).alias(f"d{k}") for k in range(n_classes)]
    )
    base = priors.groupBy().pivot("ord", list(range(n_classes))).agg(
        F.max("log_prior").alias("prior"), F.max("log_rest").alias("rest")
    )
    joined = samples.select("sample_id").join(scores, "sample_id", "left")
    joined = joined.crossJoin(F.broadcast(base))  # one row
    raw = [
        F.col(f"{k}_prior") + F.coalesce(F.col("mass"), F.lit(0.0)) * F.col(f"{k}_rest") + F.coalesce(F.col(f"d{k}"), F.lit(0.0))
        for k in range(n_classes)
    ]
    scored = joined.select("sample_id", F.array(*[F.coalesce(r, F.lit(float("-inf"))) for r in raw]).alias("raw"))
    return scored.select("sample_id", softmax(F.col("raw")).alias("p"))


def softmax(raw: Column) -> Column:
    shifted = F.transform(raw, lambda x: F.exp(x - F.array_max(raw)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)
