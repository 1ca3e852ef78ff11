"""Row filters and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.levels import LEVELS, parse_level
from gradeloom.functions.probs import total
from gradeloom.functions.text import clean_text, strip


def min_length(df: DataFrame, n: int, text: str = "text") -> DataFrame:
    return df.filter(F.length(clean_text(F.col(text))) >= n)


def not_blank(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(strip(clean_text(F.col(text))) != "")


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` first rows in key order."""
    return df.orderBy(key).limit(n)


def of_level(df: DataFrame, level: str, label: str = "label") -> DataFrame:
    return df.filter(F.col(label).isNotNull() & (F.col(label) == level))


def invalid_labels(df: DataFrame, label: str = "label", levels=LEVELS) -> DataFrame:
    """Rows whose label is not on the scale, after trimming and upper-casing."""
    return df.filter(parse_level(F.col(label), levels).isNull())


def invalid_probs(df: DataFrame, p: str = "p", confidence: str = "confidence") -> DataFrame:
    """Rows whose probabilities do not add up or whose confidence is out of range."""
    mass = total(F.col(p))
    bad_sum = ~mass.between(0.99, 1.01)
    bad_confidence = ~F.col(confidence).between(0.0, 1.0)
    return df.withColumn("bad_sum", bad_sum).withColumn("bad_confidence", bad_confidence).filter(bad_sum | bad_confidence)


# Fixed value: datasets with this in their name are training data; rankings leave them out by passing it.
TRAINING_DATA = "efcamdat-train"


def select_metrics(
    metrics: DataFrame,
    dataset: str | None = None,
    strategy: str | None = None,
    exclude: list[str] | None = None,
    exclude_containing: str | None = None,
) -> DataFrame:
    keep: Column = F.lit(True)
    if dataset:
        keep = keep & (F.col("dataset") == dataset)
    if strategy:
        keep = keep & (F.col("strategy") == strategy)
    if exclude:
        keep = keep & ~F.col("dataset").isin(*exclude)
    if exclude_containing:
        keep = keep & ~F.lower("dataset").contains(exclude_containing.lower())
    return metrics.filter(keep)
