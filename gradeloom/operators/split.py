"""Reproducible splits, label encodings and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gradeloom.functions.levels import ordinal
from gradeloom.operators.scale import require, take_by_hash


def split_random(df: DataFrame, key: str, test_size: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: exactly ``ceil(n * test_size)`` test rows by hash order."""
    quota = df.agg(F.ceil(F.count(F.lit(1)) * F.lit(float(test_size))).cast("bigint").alias("quota"))
    return _named(take_by_hash(df, [], key, quota, seed))


def stratum_quotas(df: DataFrame, strata: str, test_size: float) -> DataFrame:
    """``(stratum, quota)`` by largest remainder; ties go to the first stratum."""
    counts = df.groupBy(strata).agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(F.lit(0))  # one row per stratum
    n_all = F.sum("n").over(whole)
    shares = counts.withColumn("n_test", F.ceil(n_all * F.lit(float(test_size))).cast("bigint"))
    shares = shares.withColumn("base", F.expr("n * n_test div sum(n) over ()"))
    shares = shares.withColumn("rest", F.expr("(n * n_test) % sum(n) over ()"))
    place = F.row_number().over(whole.orderBy(F.col("rest").desc(), strata))
    extra = F.col("n_test") - F.sum("base").over(whole)
    shares = shares.withColumn("_place", place).withColumn("_extra", extra)
    quota = F.col("base") + F.when(F.col("_place") <= F.col("_extra"), 1).otherwise(0)
    return shares.select(strata, quota.cast("bigint").alias("quota"))


def split_stratified(df: DataFrame, key: str, strata: str, test_size: float, seed: int = 42) -> DataFrame:
    """Adds ``split`` with every stratum represented in proportion."""
    require(df, key, strata)
    return _named(take_by_hash(df, [strata], key, stratum_quotas(df, strata, test_size), seed))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("split", F.when(F.col("taken"), "test").otherwise("train")).drop("taken")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), the same ones on every run."""
    quota = df.agg(F.least(F.count(F.lit(1)), F.lit(n)).cast("bigint").alias("quota"))
    return take_by_hash(df, [], key, quota, seed).filter("taken").drop("taken")


def label_distribution(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Count and share per label, optionally within ``by``."""
    by = by or []
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    scope = W.partitionBy(*(by or [F.lit(0)]))  # one row per label
    return counts.withColumn("share", F.col("n") / F.sum("n").over(scope))


def encode_labels(df: DataFrame, label: str) -> DataFrame:
    """``(label, code)`` with codes 0..k-1 in label order."""
    names = df.select(F.col(label).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return names.withColumn("code", (F.row_number().over(W.orderBy("label")) - 1).cast("int"))  # one row per label


def remap_contiguous(df: DataFrame, label: str, levels) -> DataFrame:
    """``(label, ord, code)``: scale position and gap-free code of the labels present."""
    names = df.select(F.col(label).alias("label")).distinct().withColumn("ord", ordinal(F.col("label"), levels))
    names = names.filter(F.col("ord").isNotNull())
    return names.withColumn("code", (F.row_number().over(W.orderBy("ord")) - 1).cast("int"))  # one row per label


def class_weights(df: DataFrame, label: str, strategy: str = "inverse", alpha: float = 1.0) -> DataFrame:
    """``(label, n, weight)``; ``alpha`` below 1 blends towards equal weights."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = W.partitionBy(F.lit(0))  # one row per label
    balanced = F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))
    if strategy == "equal":
        return counts.withColumn("weight", F.lit(1.0))
    if strategy == "inverse":
        weight: Column = balanced
    elif strategy == "inverse_sqrt":
        weight = F.sqrt(balanced)
    else:
        raise ValueError(f"unknown weighting {strategy}")
    if alpha < 1.0:
        weight = F.lit(1.0 - alpha) + F.lit(float(alpha)) * weight
    return counts.withColumn("weight", weight)


def sample_weights(df: DataFrame, label: str, n_labels: int, strategy: str = "equal", alpha: float = 1.0) -> DataFrame:
    """Adds ``weight`` to every row; the table joined has one row per label."""
    from gradeloom.operators.scale import bounded

    weights = class_weights(df, label, strategy, alpha).select(label, "weight")
    return df.join(bounded(weights, n_labels), label, "left")
