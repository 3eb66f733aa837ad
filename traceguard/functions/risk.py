"""The ordered risk levels and their roll-up. A level is held as its rank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names in order of rank, and the least scores of the levels.
LEVELS = ("clean", "low", "medium", "high")
CLEAN, LOW, MEDIUM, HIGH = range(4)
SCORE_STEPS = ((0.9, HIGH), (0.5, MEDIUM), (0.3, LOW))


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank + 1)


def level_of_score(score: Column) -> Column:
    out = F.when(score >= SCORE_STEPS[0][0], SCORE_STEPS[0][1])
    for least, rank in SCORE_STEPS[1:]:
        out = out.when(score >= least, rank)
    return out.otherwise(CLEAN)


def highest(*ranks: Column) -> Column:
    return F.greatest(*ranks)


def when_any(found: Column, rank: int) -> Column:
    """``rank`` if the array or boolean says so, else clean."""
    return F.when(found, rank).otherwise(CLEAN)


def filled(array: Column) -> Column:
    return F.coalesce(F.size(array) > 0, F.lit(False))
