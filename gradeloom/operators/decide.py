"""From class probabilities to one label per sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions import probs as P
from gradeloom.functions.levels import LEVELS, label_at
from gradeloom.operators.scale import require


def argmax(df: DataFrame, p: str = "p", levels=LEVELS) -> DataFrame:
    """Most likely label, first in scale order on ties."""
    require(df, p)
    best = P.argmax_index(F.col(p))
    return df.withColumn("pred_ord", best).withColumn("pred_label", label_at(F.col("pred_ord"), levels)).withColumn(
        "confidence", F.array_max(p)
    )


def rounded(df: DataFrame, p: str = "p", levels=LEVELS) -> DataFrame:
    """Label nearest to the expected position on the scale."""
    n = len(levels)
    out = df.withColumn("expected_value", P.expected_value(F.col(p), n))
    out = out.withColumn("rounded_index", P.rounded_index(F.col("expected_value"), n))
    return out.withColumn("pred_label", label_at(F.col("rounded_index"), levels))


def by_threshold(df: DataFrame, thresholds: list[float], p: str = "p", levels=LEVELS) -> DataFrame:
    """Label by cut points on the expected position, one fewer than levels."""
    if len(thresholds) != len(levels) - 1 or sorted(thresholds) != list(thresholds):
        raise ValueError("need ascending cut points, one fewer than the levels")
    out = df.withColumn("expected_value", P.expected_value(F.col(p), len(levels)))
    out = out.withColumn("pred_ord", P.threshold_index(F.col("expected_value"), thresholds))
    return out.withColumn("pred_label", label_at(F.col("pred_ord"), levels))


def top_k(df: DataFrame, k: int, p: str = "p", levels=LEVELS, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """``(keys, rank, label, prob)`` of the ``k`` most likely labels."""
    listed = df.select(*keys, F.posexplode(P.top_k(F.col(p), k, levels)).alias("at", "e"))
    return listed.select(*keys, (F.col("at") + 1).alias("rank"), "e.label", "e.prob")


def latest(df: DataFrame, time: str, keys: list[str], tie: str) -> DataFrame:
    """Newest row per key; partial maxima travel, not the rows."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def both_strategies(df: DataFrame, p: str = "p", levels=LEVELS) -> DataFrame:
    """Argmax and rounded-mean predictions as rows of one table."""
    n = len(levels)
    best, mean = P.argmax_index(F.col(p)), P.expected_value(F.col(p), n)
    ready = df.withColumn("expected_value", mean).withColumn("confidence", F.array_max(p)).withColumn("_best", best)
    rows = F.array(
        F.struct(F.lit("argmax").alias("strategy"), F.col("_best").alias("pred_ord")),
        F.struct(F.lit("rounded_avg").alias("strategy"), P.rounded_index(F.col("expected_value"), n).alias("pred_ord")),
    )
    return ready.select("*", F.inline(rows)).drop("_best").withColumn("pred_label", label_at(F.col("pred_ord"), levels))


def majority_baseline(labels: DataFrame, label: str = "true_label", by: str = "dataset") -> DataFrame:
    """Most frequent label per dataset, its count and share."""
    counts = labels.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(by).agg(
        F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col(label))).alias("top"), F.sum("n").alias("n_samples")
    )
    return top.select(by, F.col(f"top.{label}").alias("majority_label"), F.col("top.n").alias("n"), "n_samples").withColumn(
        "accuracy", F.col("n") / F.col("n_samples")
    )


def correctness(df: DataFrame, true: str = "true_label", pred: str = "pred_label") -> DataFrame:
    return df.withColumn("correct", F.coalesce(F.col(true) == F.col(pred), F.lit(False)))
