"""How well stated confidence matches how often predictions are right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.operators.metrics import ratio

KEYS = ("model", "dataset")


def bin_of(confidence: Column, n_bins: int = 10) -> Column:
    """Bin ``k`` covers ``((k-1)/n, k/n]``; confidence 0 is in bin 0, i.e. in none.

    The edges are products ``k * (1/n)`` in double arithmetic.
    """
    edges = [k * (1.0 / n_bins) for k in range(n_bins)]
    return reduce(lambda a, b: a + b, [F.when(confidence > F.lit(e), 1).otherwise(0) for e in edges]).cast("int")


def bins(predictions: DataFrame, keys=KEYS, n_bins: int = 10) -> DataFrame:
    """Count, accuracy, mean confidence and gap of every bin, empty ones as 0."""
    right = F.coalesce((F.col("true_ord") == F.col("pred_ord")).cast("double"), F.lit(0.0))
    placed = predictions.groupBy(*keys, bin_of(F.col("confidence"), n_bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(right).alias("n_right"), F.sum("confidence").alias("sum_confidence")
    )
    entry = F.struct("bin", "n", "n_right", "sum_confidence")
    rows = placed.groupBy(*keys).agg(F.collect_list(entry).alias("have"), F.sum("n").alias("n_all"))
    every = F.transform(
        F.sequence(F.lit(1), F.lit(n_bins)),
        lambda k: F.coalesce(
            F.get(F.filter("have", lambda e: e["bin"] == k), F.lit(0)),
            F.struct(k.alias("bin"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("n_right"), F.lit(0.0).alias("sum_confidence")),
        ),
    )
    out = rows.select(*keys, "n_all", F.inline(every))
    accuracy, confidence = ratio(F.col("n_right"), F.col("n")), ratio(F.col("sum_confidence"), F.col("n"))
    return out.select(
        *keys, "bin", "n", "n_all", accuracy.alias("accuracy"), confidence.alias("mean_confidence"), (confidence - accuracy).alias("gap")
    )


def expected_error(binned: DataFrame, keys=KEYS) -> DataFrame:
    """Expected calibration error: mean absolute gap weighted by bin share."""
    return binned.groupBy(*keys).agg(F.sum(F.abs("gap") * F.col("n") / F.col("n_all")).alias("ece"))


def per_class(predictions: DataFrame, keys=KEYS) -> DataFrame:
    """Mean probability of the predicted class, accuracy and count per class."""
    right = F.coalesce((F.col("true_ord") == F.col("pred_ord")).cast("double"), F.lit(0.0))
    return predictions.groupBy(*keys, "pred_label").agg(
        F.avg("confidence").alias("avg_prob"), F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n")
    )
