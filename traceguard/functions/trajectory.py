"""Slopes of risk scores over turns or ancestors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What makes a rise.
SLOPE, TURNS, CURRENT = 0.3, 3, 0.25


def slope(scores: Column) -> Column:
    """Least-squares slope over positions 0, 1, ...; 0 for fewer than two. Sums run in order, in two passes."""
    n = F.size(scores)
    x_mean = (n - 1) / F.lit(2.0)
    y_mean = F.aggregate(scores, F.lit(0.0), lambda s, y: s + y) / n
    pairs = F.transform(scores, lambda y, i: F.struct((i - x_mean).alias("x"), (y - y_mean).alias("y")))
    num = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["x"] * p["y"])
    den = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + p["x"] * p["x"])
    return F.when(n >= 2, num / den).otherwise(0.0)


def rising(scores: Column) -> Column:
    """Whether the scores, the current one last, climb: steep, long and high enough."""
    return F.coalesce((slope(scores) >= SLOPE) & (F.size(scores) >= TURNS) & (F.element_at(scores, -1) >= CURRENT), F.lit(False))
