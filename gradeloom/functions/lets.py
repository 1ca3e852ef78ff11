"""Small helpers for higher-order column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def int_range(first: int, last: Column) -> Column:
    """``first..last`` as an array, empty when ``last < first``."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def double_literals(values) -> Column:
    """A constant array<double>."""
    return F.array(*[F.lit(float(v)) for v in values])
