"""Ranking and tabulating metric records.

Metric tables have one row per (model, dataset, strategy): they are the output
of the evaluation aggregate and small, so plain windows serve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradeloom.functions.names import display_name

# The criteria of the summary tables and the two strategies.
CRITERIA = ("accuracy", "adjacent_accuracy", "macro_f1", "weighted_f1", "micro_f1")
STRATEGIES = ("argmax", "rounded_avg")


def merit(criterion: str) -> Column:
    """Sort value: unknown last; what differs only in the last bits of a
    floating-point sum, whose order is not fixed, counts as equal."""
    return F.coalesce(F.round(criterion, 9), F.lit(-1.0))


def best_first(criterion: str) -> list[Column]:
    """Descending, then by name."""
    return [merit(criterion).desc(), F.col("model"), F.col("dataset"), F.col("strategy")]


def rank(metrics: DataFrame, criterion: str = "accuracy") -> DataFrame:
    scope = W.partitionBy(F.lit(0)).orderBy(*best_first(criterion))
    return metrics.withColumn("rank", F.row_number().over(scope))


def rank_by_dataset(metrics: DataFrame, criterion: str, top: int | None = None) -> DataFrame:
    scope = W.partitionBy("dataset").orderBy(*best_first(criterion))
    ranked = metrics.withColumn("rank", F.row_number().over(scope))
    return ranked.filter(F.col("rank") <= top) if top else ranked


def top_by_criteria(metrics: DataFrame, n: int = 10, criteria=CRITERIA, strategies=STRATEGIES) -> DataFrame:
    """``(criterion, strategy, rank, model, dataset, value)``."""
    long = metrics.filter(F.col("strategy").isin(*strategies)).unpivot(
        ["model", "dataset", "strategy"], list(criteria), "criterion", "value"
    )
    scope = W.partitionBy("criterion", "strategy").orderBy(merit("value").desc(), "model", "dataset")
    ranked = long.withColumn("rank", F.row_number().over(scope)).filter(F.col("rank") <= n)
    return ranked.select("criterion", "strategy", "rank", "model", "dataset", "value")


def average_micro_f1(metrics: DataFrame) -> DataFrame:
    """Mean over datasets per (model, strategy) with the per-dataset scores."""
    scores = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("micro_f1").isNotNull(), F.struct("dataset", "micro_f1")))))
    out = metrics.groupBy("model", "strategy").agg(
        F.avg("micro_f1").alias("micro_f1"),
        F.sum("n_samples").alias("n_samples"),
        F.count(F.lit(1)).alias("n_datasets"),
        scores.alias("per_dataset"),
    )
    named = F.concat(F.lit("avg_across_"), F.col("n_datasets").cast("string"), F.lit("_datasets"))
    return out.filter(F.col("micro_f1").isNotNull()).withColumn("dataset", named)


def dataset_names(metrics: DataFrame) -> list[str]:
    """The datasets of a metric table, which is tiny, in order."""
    return [r["dataset"] for r in metrics.select("dataset").distinct().orderBy("dataset").collect()]


def average_table(metrics: DataFrame, strategy: str, datasets: list[str] | None = None) -> DataFrame:
    """Average micro F1 over all datasets, with one column for each of ``datasets`` (default: all)."""
    datasets = datasets or dataset_names(metrics)
    avg = average_micro_f1(metrics.filter(F.col("strategy") == strategy))
    columns = [F.element_at("per_dataset", F.lit(d)).alias(d) for d in datasets]
    return avg.select("model", "strategy", "micro_f1", "n_samples", *columns)


def f1_pivot(metrics: DataFrame, datasets: list[str] | None = None, strategy: str = "argmax") -> DataFrame:
    """Models by datasets of weighted F1 (macro where it is missing or 0) and the mean over all datasets."""
    datasets = datasets or dataset_names(metrics)
    best = F.when(F.col("weighted_f1") != 0, F.col("weighted_f1")).otherwise(F.coalesce("macro_f1", "weighted_f1"))
    rows = metrics.filter(F.col("strategy") == strategy).withColumn("f1", best)
    wide = rows.groupBy("model").pivot("dataset", datasets).agg(F.max("f1"))
    per_dataset = rows.groupBy("model", "dataset").agg(F.max("f1").alias("f1"))
    mean = per_dataset.groupBy("model").agg(F.avg("f1").alias("avg"))
    return wide.join(mean, "model").withColumn("display_name", display_name(F.col("model")))


def dataset_detail(metrics: DataFrame, dataset: str, strategy: str = "argmax") -> DataFrame:
    """One dataset's records, best weighted F1 first."""
    rows = metrics.filter((F.col("dataset") == dataset) & (F.col("strategy") == strategy))
    order = F.coalesce(F.when(F.col("weighted_f1") != 0, F.col("weighted_f1")), F.col("macro_f1"), F.lit(0.0))
    place = F.row_number().over(W.partitionBy("dataset").orderBy(F.round(order, 9).desc(), "model"))
    return rows.select(
        place.alias("rank"), display_name(F.col("model")).alias("display_name"), "model", "n_samples",
        "accuracy", "adjacent_accuracy", "macro_f1", "weighted_f1",
    )


def best_per_dataset(metrics: DataFrame, strategy: str = "argmax") -> DataFrame:
    """Best model by accuracy and by adjacent accuracy; first name on ties."""
    def best(column: str) -> Column:
        return F.min_by(F.struct("model", column), F.struct(-F.coalesce(F.round(column, 9), F.lit(0.0)), F.col("model")))

    rows = metrics.filter(F.col("strategy") == strategy).groupBy("dataset").agg(
        best("accuracy").alias("a"), best("adjacent_accuracy").alias("b"), F.count(F.lit(1)).alias("n_models")
    )
    return rows.select(
        "dataset", F.col("a.model").alias("best_model"), F.col("a.accuracy").alias("best_accuracy"),
        F.col("b.model").alias("best_adjacent_model"), F.col("b.adjacent_accuracy").alias("best_adjacent_accuracy"), "n_models",
    )


def config_analysis(metrics: DataFrame, feature_set: str = "feature_set") -> DataFrame:
    """Accuracy per feature configuration over its argmax evaluations."""
    rows = metrics.filter((F.col("strategy") == "argmax") & F.col(feature_set).isNotNull() & F.col("accuracy").isNotNull())
    return rows.groupBy(feature_set).agg(
        F.avg("accuracy").alias("avg_accuracy"), F.min("accuracy").alias("min_accuracy"),
        F.max("accuracy").alias("max_accuracy"), F.count(F.lit(1)).alias("n_evaluations"),
    )


def overview(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count_distinct("model").alias("n_models"), F.count_distinct("dataset").alias("n_datasets"),
        F.count_distinct("strategy").alias("n_strategies"), F.count(F.lit(1)).alias("n_evaluations"),
    )


def compare_published(metrics: DataFrame, published: DataFrame, column: str) -> DataFrame:
    """Published against measured values on (model, dataset)."""
    ours = metrics.select("model", "dataset", F.col(column).alias("measured"))
    return published.join(ours, ["model", "dataset"], "left").withColumn("difference", F.col("measured") - F.col("published"))
