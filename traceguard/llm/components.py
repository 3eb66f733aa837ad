"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Aggregates of so many rows, at most 24 bytes each, can be broadcast.
MANY = 200_000


def beside(small: DataFrame, rows: int) -> DataFrame:
    """An aggregate of ``rows`` rows, made ready to be joined with them: none of them then waits for a hot key."""
    return F.broadcast(small) if rows <= MANY else materialize(small, "beside")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the smallest node that it reaches.

    ``edges``: two columns u, v of longs; loops, repeated and reversed rows are allowed, nulls are dropped.
    Each round costs two shuffles of the links and is written to the shared folder, so a lost executor costs
    one round at most. The minima of up to ``MANY`` links are broadcast; more are written before they are joined, so
    that Spark can split a node with many links.
    Star-shaped links take two or three rounds, a path of n nodes about log n.
    """
    u, v = edges.columns
    links = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u > v").distinct()
    links, before = materialize(links, "links"), None
    while (now := _state(links)) != before:
        before = now
        both = links.union(links.select(F.col("v"), F.col("u")))
        low = beside(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), now[0])
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = beside(large.groupBy("u").agg(F.min("v").alias("m")), now[0])
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        links = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
