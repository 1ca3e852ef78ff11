"""Aligning tables by key, with the rows that do not match kept visible."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from gradeloom.operators.scale import BROADCAST_ROWS, require


def with_labels(rows: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows that have a label."""
    require(rows, key), require(labels, key)
    return rows.join(labels, key, "inner")


def with_optional_labels(rows: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    """All rows; the label is null where none is known."""
    return rows.join(labels, key, "left")


def unmatched(rows: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    """``(key, side)`` of rows without label and labels without row."""
    left = rows.select(key).join(labels.select(key), key, "left_anti").select(key, F.lit("no_label").alias("side"))
    right = labels.select(key).join(rows.select(key), key, "left_anti").select(key, F.lit("no_row").alias("side"))
    return left.unionByName(right)


def labelled_only(rows: DataFrame, labels: DataFrame, key: str = "sample_id") -> DataFrame:
    return rows.join(labels.select(key), key, "left_semi")


def remove_samples(rows: DataFrame, removed: DataFrame, key: str = "sample_id") -> DataFrame:
    return rows.join(removed.select(key), key, "left_anti")


def feature_coverage(samples: DataFrame, features: DataFrame, by: str, key: str = "sample_id") -> DataFrame:
    """Per ``by``: sample count, samples without features, and whether all have some."""
    have = features.select(key).distinct().withColumn("_have", F.lit(1))
    joined = samples.select(by, key).join(have, key, "left")
    counted = joined.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("_have").isNull()).alias("n_missing")
    )
    return counted.withColumn("has_features", F.col("n_missing") == 0)


def match_models(models: DataFrame, feature_sets: DataFrame, datasets: DataFrame, label_files: DataFrame) -> DataFrame:
    """Jobs to predict: model x dataset of its feature set, with labels if known.

    ``models(model, feature_key)``, ``feature_sets(feature_key)``,
    ``datasets(feature_key, dataset)``, ``label_files(dataset, label_file)``.
    """
    usable = models.join(feature_sets.select("feature_key").distinct(), "feature_key", "left_semi")
    return usable.join(datasets, "feature_key").join(label_files, "dataset", "left")


def orphan_models(models: DataFrame, feature_sets: DataFrame) -> DataFrame:
    """Models whose feature set does not exist."""
    return models.join(feature_sets.select("feature_key").distinct(), "feature_key", "left_anti")


def grid(*sides: DataFrame) -> DataFrame:
    """Every combination of a few short configuration lists.

    They are counted, and refused when one list, or the grid, has more than ``BROADCAST_ROWS`` rows: tables of data are joined by key.
    """
    counts = [side.count() for side in sides]
    if max(*counts, math.prod(counts)) > BROADCAST_ROWS:
        raise ValueError(f"lists of {counts} rows; at most {BROADCAST_ROWS}, and as many in the grid")
    out = sides[0]
    for side in sides[1:]:
        out = out.crossJoin(F.broadcast(side))  # counted above
    return out
