"""Two-stage model selection: cheap screening, then tuning of the survivors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def screen(scores: DataFrame, metric: str, threshold: float | None = None, percentile: float | None = None) -> DataFrame:
    """Rank ``(feature_set, score)`` and mark what is discarded, with the reason.

    One row per candidate configuration, so an unpartitioned ranking is small.
    """
    whole = W.partitionBy(F.lit(0))
    ranked = scores.withColumn("rank", F.row_number().over(whole.orderBy(F.round("score", 9).desc(), "feature_set")))
    ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(whole))
    below = F.lit(False) if threshold is None else F.col("score") < F.lit(float(threshold))
    cut = F.lit(0) if percentile is None else F.floor(F.col("_n") * F.lit(float(percentile)) / 100)
    bottom = F.col("rank") > F.col("_n") - cut
    digits = lambda c: F.format_string("%.4f", c)
    why = F.when(
        below, F.concat(F.lit(f"{metric} "), digits(F.col("score")), F.lit(f" < threshold {threshold or 0:.4f}"))
    ).when(bottom, F.lit(f"Bottom {percentile}% percentile"))
    return ranked.withColumn("passed", ~(below | bottom)).withColumn("discard_reason", why).drop("_n")


def survivors(screened: DataFrame, k: int) -> DataFrame:
    """The ``k`` best configurations that passed."""
    return screened.filter("passed").orderBy("rank").limit(k)


def best_trials(history: DataFrame) -> DataFrame:
    """Best trial per feature set with the number of trials; first trial on ties."""
    best = F.min_by(F.struct("trial", "params", "score"), F.struct(-F.round("score", 9), F.col("trial")))
    rows = history.groupBy("feature_set").agg(best.alias("b"), F.count(F.lit(1)).alias("n_trials"))
    return rows.select(
        "feature_set", F.col("b.trial").alias("best_trial"), F.col("b.params").alias("best_params"),
        F.col("b.score").alias("best_score"), "n_trials",
    )


def final_ranking(chosen: DataFrame, best: DataFrame) -> DataFrame:
    """Survivors with tuned score, improvement and their new rank."""
    joined = chosen.select("feature_set", F.col("score").alias("stage1_score")).join(best, "feature_set")
    joined = joined.withColumn("improvement", F.col("best_score") - F.col("stage1_score"))
    order = W.partitionBy(F.lit(0)).orderBy(F.round("best_score", 9).desc(), "feature_set")
    return joined.withColumn("final_rank", F.row_number().over(order))
