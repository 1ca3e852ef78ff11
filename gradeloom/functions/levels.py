"""The ordered label scale."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeloom.functions.text import strip

# The label scale in its order.
LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")

MAX_ORD = len(LEVELS) - 1


def ordinal(label: Column, levels=LEVELS) -> Column:
    """Position of a label on the scale, null when it is none of its levels."""
    at = F.array_position(F.array(*[F.lit(l) for l in levels]), label)
    return F.when(at > 0, (at - 1).cast("int"))


def label_at(ord_: Column, levels=LEVELS) -> Column:
    """Label of an ordinal, null outside the scale."""
    return F.get(F.array(*[F.lit(l) for l in levels]), ord_.cast("int"))


def parse_level(text: Column, levels=LEVELS) -> Column:
    """Upper-cased, trimmed label; null when it is not on the scale."""
    clean = F.upper(strip(text))
    return F.when(clean.isin(*levels), clean)


def is_valid_ord(ord_: Column, levels=LEVELS) -> Column:
    return F.coalesce((ord_ >= 0) & (ord_ < len(levels)), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def is_adjacent(a: Column, b: Column, tolerance: int = 1) -> Column:
    return F.abs(a - b) <= tolerance
