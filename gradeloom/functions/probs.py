"""Decision rules on arrays of class probabilities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from gradeloom.functions.levels import LEVELS
from gradeloom.functions.lets import double_literals, let


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda acc, x: acc + x)


def argmax_index(p: Column) -> Column:
    """0-based index of the largest entry, the first one on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def expected_value(p: Column, n: int = len(LEVELS)) -> Column:
    """Probability-weighted mean of the class indices."""
    weighted = F.zip_with(p, double_literals(range(n)), lambda x, k: x * k)
    return total(weighted)


def rounded_index(expected: Column, n: int = len(LEVELS)) -> Column:
    """Half-even rounding, clipped to the scale."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(expected).cast("int")))


def threshold_index(expected: Column, thresholds) -> Column:
    """Number of thresholds that the expected value reaches."""
    hits = [F.when(expected >= F.lit(float(t)), 1).otherwise(0) for t in thresholds]
    return reduce(lambda a, b: a + b, hits).cast("int")


def top_k(p: Column, k: int, levels=LEVELS) -> Column:
    """The ``k`` most likely ``struct<label, prob>``, scale order on ties."""
    names = F.array(*[F.lit(l) for l in levels])
    ranked = F.array_sort(
        F.transform(p, lambda x, i: F.struct((-x).alias("neg"), i.alias("ord"), F.get(names, i).alias("label")))
    )
    return F.transform(F.slice(ranked, 1, k), lambda e: F.struct(e["label"].alias("label"), (-e["neg"]).alias("prob")))


def is_distribution(p: Column, low: float = 0.99, high: float = 1.01) -> Column:
    """True when the entries add up to one within the tolerance."""
    return total(p).between(low, high)


def one_hot(ord_: Column, n: int = len(LEVELS)) -> Column:
    return let(ord_, lambda o: F.array(*[F.when(o == k, F.lit(1.0)).otherwise(F.lit(0.0)) for k in range(n)]))


def from_map(m: Column, levels=LEVELS) -> Column:
    """Map label -> probability as an array in scale order; missing is 0."""
    return F.array(*[F.coalesce(F.element_at(m, F.lit(l)), F.lit(0.0)) for l in levels])


def to_map(p: Column, levels=LEVELS) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(l) for l in levels]), p)
