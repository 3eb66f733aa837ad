"""Centroids, cosine scores, the two-scope verdict, and classifier windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds and window sizes.
INJECTION_THRESHOLD, JAILBREAK_THRESHOLD, POISON_THRESHOLD, REPORT_THRESHOLD = 0.41, 0.46, 0.55, 0.34
WINDOW, STRIDE, MOST_WINDOWS = 1200, 900, 8
CLASSIFIER_THRESHOLD = 0.90


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; zeros stay."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 for null and zero vectors."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, centroid): the mean of each label's unit vectors, brought to length 1."""
    parts = vectors.select(F.col(label), F.posexplode(unit(F.col(vector))).alias("at", "x")).groupBy(label, "at").agg(F.avg("x").alias("x"))
    joined = parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]).alias("mean"))
    return joined.select(label, unit(F.col("mean")).alias("centroid"))


def verdict(injection: Column, jailbreak: Column) -> Column:
    """struct(detected, scope, score) of the scores of the two scopes.

    Injection counts from its threshold on if it is not below jailbreak; else jailbreak counts from its own.
    """
    i = (injection >= INJECTION_THRESHOLD) & (injection >= jailbreak)
    j = ~i & (jailbreak >= JAILBREAK_THRESHOLD)
    return F.struct((i | j).alias("detected"), F.when(i, "injection").when(j, "jailbreak").otherwise("").alias("scope"), F.when(i, injection).when(j, jailbreak).otherwise(F.greatest(injection, jailbreak)).alias("score"))


def windows(text: Column) -> Column:
    """The text itself if short, else windows at every stride, so many at most."""
    starts = F.slice(F.sequence(F.lit(0), F.length(text) - 1, F.lit(STRIDE)), 1, MOST_WINDOWS)
    return F.when(F.length(text) <= WINDOW, F.array(text)).otherwise(F.transform(starts, lambda s: F.substring(text, s + 1, WINDOW)))


def classifier_verdict(score: Column, blocking: bool = False) -> Column:
    """struct(detected, score): advisory unless ``blocking``."""
    return F.struct(((score >= CLASSIFIER_THRESHOLD) & F.lit(blocking)).alias("detected"), score.alias("score"))
