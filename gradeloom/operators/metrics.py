"""Evaluation metrics, all derived from one small confusion table.

The only pass over prediction rows is the count per (keys, true, predicted),
which is combined before the shuffle. Everything else works on that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.levels import LEVELS, MAX_ORD
from gradeloom.operators.scale import require

KEYS = ("model", "dataset", "strategy")


def confusion(predictions: DataFrame, keys=KEYS, true: str = "true_ord", pred: str = "pred_ord", weight: str | None = None) -> DataFrame:
    """``(keys, true_ord, pred_ord, n, w)``; ``w`` is the summed sample weight."""
    require(predictions, *keys, true, pred)
    mass = F.sum(weight) if weight else F.count(F.lit(1)).cast("double")
    return predictions.groupBy(*keys, F.col(true).alias("true_ord"), F.col(pred).alias("pred_ord")).agg(
        F.count(F.lit(1)).alias("n"), mass.alias("w")
    )


def dense_confusion(cm: DataFrame, keys=KEYS, n: int = len(LEVELS)) -> DataFrame:
    """Adds a zero row for each absent cell whose true label occurs in the group."""
    cells = cm.groupBy(*keys, "true_ord").agg(F.map_from_entries(F.collect_list(F.struct("pred_ord", "n"))).alias("row"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pred_ord")
    return cells.select(*keys, "true_ord", "row", every).select(
        *keys, "true_ord", "pred_ord", F.coalesce(F.element_at("row", F.col("pred_ord")), F.lit(0)).alias("n")
    )


def class_counts(cm: DataFrame, keys=KEYS, mass: str = "n", extra: dict[str, Column] | None = None) -> DataFrame:
    """``(keys, ord, tp, n_pred, support)`` per label seen as truth or prediction.

    ``extra`` adds sums over the cells of a true label, so that one chain of
    aggregates can serve several metrics. A label off the scale has a null
    ``ord``.
    """
    m = F.col(mass)
    zero = F.lit(0).cast(cm.schema[mass].dataType)
    hit = F.when(F.col("true_ord") == F.col("pred_ord"), m).otherwise(zero)
    more = extra or {}
    sides = F.array(
        F.struct(
            F.col("true_ord").alias("ord"), hit.alias("tp"), zero.alias("n_pred"), m.alias("support"),
            *[c.cast("double").alias(n) for n, c in more.items()],
        ),
        F.struct(
            F.col("pred_ord").alias("ord"), zero.alias("tp"), m.alias("n_pred"), zero.alias("support"),
            *[F.lit(0.0).alias(n) for n in more],
        ),
    )
    sums = [F.sum(c).alias(c) for c in ("tp", "n_pred", "support", *more)]
    return cm.select(*keys, F.inline(sides)).groupBy(*keys, "ord").agg(*sums)


def ratio(a: Column, b: Column) -> Column:
    """Division that gives 0 where nothing was counted."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_report(cm: DataFrame, keys=KEYS, mass: str = "n", labels: str = "union") -> DataFrame:
    """Precision, recall, F1 and support per label.

    ``labels``: ``union`` of truth and prediction, or ``truth`` only.
    """
    counts = class_counts(cm, keys, mass).filter(F.col("ord").isNotNull())
    if labels == "truth":
        counts = counts.filter(F.col("support") > 0)
    precision, recall = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2 * F.col("tp"), F.col("n_pred") + F.col("support"))
    return counts.select("*", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def averages(report: DataFrame, keys=KEYS) -> DataFrame:
    """Macro and support-weighted averages, pooled F1, and the support."""
    share = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    tp, pooled = F.sum("tp"), F.sum(F.col("n_pred") + F.col("support"))
    return report.groupBy(*keys).agg(
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[share(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")],
        ratio(2 * tp, pooled).alias("micro_f1"),
        F.sum("support").alias("support"),
        F.count(F.lit(1)).alias("n_labels"),
    )


def _mean(value: Column, mass: str) -> Column:
    return ratio(F.sum(value * F.col(mass)), F.sum(mass))


def _gap() -> Column:
    return F.abs(F.col("true_ord") - F.col("pred_ord"))


def accuracy(cm: DataFrame, keys=KEYS, mass: str = "n") -> DataFrame:
    return cm.groupBy(*keys).agg(_mean(F.coalesce((_gap() == 0).cast("int"), F.lit(0)), mass).alias("accuracy"), F.sum("n").alias("n_samples"))


def adjacent_accuracy(cm: DataFrame, keys=KEYS, mass: str = "n", tolerance: int = 1) -> DataFrame:
    """Share of all truths predicted within ``tolerance``; unknown labels miss."""
    hit = F.coalesce((_gap() <= tolerance).cast("int"), F.lit(0))
    return cm.groupBy(*keys).agg(_mean(hit, mass).alias("adjacent_accuracy"))


def ordinal_scores(cm: DataFrame, keys=KEYS, mass: str = "n", top: int = MAX_ORD) -> DataFrame:
    """Ordinal accuracy, distance scores, MSE score, MAE, MSE and RMSE."""
    d = _gap()
    squared = _mean(d * d, mass)
    return cm.groupBy(*keys).agg(
        _mean((d <= 1).cast("int"), mass).alias("ordinal_accuracy"),
        _mean(1.0 - d / F.lit(float(top)), mass).alias("ordinal_distance_linear"),
        _mean(1.0 - (d * d) / F.lit(float(top * top)), mass).alias("ordinal_distance_quadratic"),
        (1.0 - squared / F.lit(float(top * top))).alias("ordinal_mse"),
        _mean(d, mass).alias("mae"),
        squared.alias("mse"),
        F.sqrt(squared).alias("rmse"),
    )


def _scored_classes(cm: DataFrame, keys, mass: str, extra: dict[str, Column]) -> DataFrame:
    counts = class_counts(cm, keys, mass, extra)
    return counts.select(
        "*",
        ratio(F.col("tp"), F.col("n_pred")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("n_pred") + F.col("support")).alias("f1"),
    )


def metric_set(cm: DataFrame, keys=KEYS, mass: str = "w", top: int = MAX_ORD) -> DataFrame:
    """The ten selectable metrics, weighted, in one row per group and one pass."""
    d, m = _gap(), F.col(mass)
    extra = {
        "near": m * (d <= 1).cast("int"), "linear": m * (1.0 - d / F.lit(float(top))),
        "quadratic": m * (1.0 - (d * d) / F.lit(float(top * top))), "squared": m * d * d,
    }
    rows = _scored_classes(cm, keys, mass, extra)
    known, support = F.col("ord").isNotNull(), F.sum("support")
    over = lambda c: F.avg(F.when(known, F.col(c)))
    return rows.groupBy(*keys).agg(
        ratio(F.sum("tp"), support).alias("accuracy"),
        over("f1").alias("f1_macro"),
        ratio(F.sum(F.col("f1") * F.col("support")), support).alias("f1_weighted"),
        ratio(2 * F.sum("tp"), F.sum(F.col("n_pred") + F.col("support"))).alias("f1_micro"),
        over("precision").alias("precision_macro"),
        over("recall").alias("recall_macro"),
        ratio(F.sum("near"), support).alias("ordinal_accuracy"),
        ratio(F.sum("linear"), support).alias("ordinal_distance_linear"),
        ratio(F.sum("quadratic"), support).alias("ordinal_distance_quadratic"),
        (1.0 - ratio(F.sum("squared"), support) / F.lit(float(top * top))).alias("ordinal_mse"),
    )


def report_metrics(cm: DataFrame, keys=KEYS) -> DataFrame:
    """The metric record of every (model, dataset, strategy), in one pass.

    F1 averages cover the labels present in the truth and are 0 when fewer than
    two of them are; the accuracies count every truth, known label or not.
    """
    near = F.col("n") * F.coalesce((_gap() <= 1).cast("int"), F.lit(0))
    rows = _scored_classes(cm, keys, "n", {"near": near})
    label = F.col("ord").isNotNull() & (F.col("support") > 0)
    of_label = lambda c: F.when(label, c)
    several = lambda value, name: F.when(F.count_if(label) > 1, value).otherwise(F.lit(0.0)).alias(name)
    weighted = ratio(F.sum(of_label(F.col("f1") * F.col("support"))), F.sum(of_label(F.col("support"))))
    micro = ratio(2 * F.sum(of_label(F.col("tp"))), F.sum(of_label(F.col("n_pred") + F.col("support"))))
    return rows.groupBy(*keys).agg(
        ratio(F.sum("tp"), F.sum("support")).alias("accuracy"),
        ratio(F.sum("near"), F.sum("support")).alias("adjacent_accuracy"),
        several(F.avg(of_label(F.col("f1"))), "macro_f1"),
        several(weighted, "weighted_f1"),
        several(micro, "micro_f1"),
        F.sum("support").alias("n_samples"),
    )
