"""Two-stage model selection over feature sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.operators import metrics
from gradeloom.operators.decide import argmax
from gradeloom.operators.models import FITS, draw_params, history_table, tune
from gradeloom.operators.screening import best_trials, final_ranking, screen, survivors
from gradeloom.operators.split import split_stratified
from gradeloom.session import written


def score_predictions(predicted: DataFrame, metric: str) -> float:
    """One metric of predictions with ``p`` and ``ord``; a single number is fetched."""
    judged = argmax(predicted).select(F.lit("m").alias("model"), F.col("ord").alias("true_ord"), "pred_ord")
    cm = metrics.confusion(judged, ("model",))
    return float(metrics.metric_set(cm, ("model",)).select(metric).first()[0])


def two_stage(
    spark: SparkSession,
    feature_sets: dict[str, DataFrame],
    kind: str,
    n_classes: int,
    metric: str = "f1_macro",
    base: dict | None = None,
    top_k: int = 2,
    n_trials: int = 3,
    valid_share: float = 0.2,
    threshold: float | None = None,
    percentile: float | None = None,
    trials: list[dict] | None = None,
) -> DataFrame:
    """Screen all feature sets with base settings, tune the survivors, rank them."""
    parts, scores = {}, []
    for name, rows in feature_sets.items():
        split = written(split_stratified(rows, "sample_id", "ord", valid_share), "split")
        parts[name] = (split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split"))
        fitted = FITS[kind](parts[name][0], n_classes, **(base or {}))
        scores.append((name, score_predictions(fitted.predict(parts[name][1]), metric)))
    screened = screen(spark.createDataFrame(scores, "feature_set string, score double"), metric, threshold, percentile)
    chosen = survivors(screened, top_k)
    settings = trials or draw_params(kind, n_trials)
    history = None
    for (name,) in chosen.select("feature_set").collect():  # at most top_k names
        runs = tune(*parts[name], kind, n_classes, settings, lambda p: score_predictions(p, metric))
        table = history_table(spark, name, runs)
        history = table if history is None else history.unionByName(table)
    return final_ranking(chosen, best_trials(history))
