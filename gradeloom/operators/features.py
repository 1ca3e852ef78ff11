"""Feature tables: joining blocks and cleaning numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.operators.scale import require


def prefix_features(block: DataFrame, source: str | Column, sep: str = "__") -> DataFrame:
    """Prefix every feature name by its source."""
    src = F.lit(source) if isinstance(source, str) else source
    return block.withColumn("feature", F.concat(src, F.lit(sep), F.col("feature")))


def concat_blocks(blocks: dict[str, DataFrame], sep: str = "__") -> DataFrame:
    """Put the features of several sources side by side, keyed by sample."""
    if not blocks:
        raise ValueError("nothing to join")
    parts = [prefix_features(b.select("sample_id", "feature", "value"), name, sep) for name, b in blocks.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def concat_feature_sets(features: DataFrame, names: list[str]) -> DataFrame:
    """Merge named feature sets per dataset: set ``a++b``, features ``a-f``.

    Works on ``(dataset, feature_set, sample_id, feature, value)``; a set that
    lacks a dataset simply adds nothing to it.
    """
    require(features, "dataset", "feature_set", "sample_id", "feature", "value")
    if len(names) < 2:
        raise ValueError("merging needs at least two feature sets")
    return features.filter(F.col("feature_set").isin(*names)).select(
        "dataset",
        F.lit("++".join(names)).alias("feature_set"),
        "sample_id",
        F.concat_ws("-", "feature_set", "feature").alias("feature"),
        "value",
    )


def numeric_columns(df: DataFrame, drop: tuple[str, ...] = ("text", "model"), keep: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Everything but ``keep`` as a number; what is not one becomes 0."""
    chosen = [c for c in df.columns if c not in drop]
    return df.select(
        *[F.col(c) if c in keep else F.coalesce(F.nanvl(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in chosen]
    )


def unpivot_features(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wide numeric columns to ``(keys, feature, value)``."""
    values = [c for c in df.columns if c not in keys]
    return df.unpivot(keys, values, "feature", "value")


def pivot_features(df: DataFrame, features: list[str], keys: list[str] | None = None) -> DataFrame:
    """Long to wide for a short, explicit feature list; absent is 0."""
    return df.groupBy(*(keys or ["sample_id"])).pivot("feature", features).agg(F.max("value")).fillna(0.0)
