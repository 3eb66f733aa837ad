"""Exact vector search as a join of query blocks and shards.

Queries are dealt into blocks and vectors into shards by hash, and every block meets every shard in one cell. A
shuffle brings both to the cell's task, queries first: the task holds one block, and the shard streams through it
in tiles. Lists of each query are cut to k in each tile, merged in each cell, and merged again by a shuffle on the
query, so the rows that leave a cell are at most k for each of its queries. Nothing goes through the driver but the
sizes of both sides, from which the numbers of blocks and shards follow.

Within a task, rows are told apart by dimension and by the size of their largest component (bands of 256 binary
exponents), so that numbers of one tile side can be scaled together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import own_thread

#: Bytes of a query block, which a task holds, and of a shard, which streams through it.
QUERY_BYTES, SHARD_BYTES = 32 << 20, 256 << 20
#: A tile has at most so many queries, rows of a shard, and numbers in either side.
BLOCK, SHARD, TILE_NUMBERS = 1024, 4096, 1 << 22
#: Binary exponents of a band.
BAND = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) without nulls, null or non-finite components, and empty vectors."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(dimension, band, ids, vectors as doubles) of a batch; a row with ``copies`` comes up so often."""
    ids = batch.column("vec_id").to_numpy()
    column = batch.column("embedding")
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy().astype(np.float64)
    start = np.cumsum(sizes) - sizes
    copies = batch.column("copies").to_numpy()
    most = np.maximum.reduceat(np.abs(flat), start)
    band = np.frexp(most)[1] // BAND
    for dim, of in np.unique(np.stack([sizes, band], 1), axis=0):
        rows = np.repeat(np.flatnonzero((sizes == dim) & (band == of)), copies[(sizes == dim) & (band == of)])
        step = max(1, min(SHARD, TILE_NUMBERS // int(dim)))
        for i in range(0, len(rows), step):
            part = rows[i : i + step]
            yield int(dim), int(of), ids[part], flat[start[part][:, None] + np.arange(dim)]


def merge(ids: np.ndarray, keys: np.ndarray, k: int, n: int, query: np.ndarray) -> np.ndarray:
    """Positions of the first k rows of each query (0 <= query < n) by (key ascending, id ascending)."""
    order = np.lexsort((ids, keys, query))
    counts = np.bincount(query, minlength=n)
    rank = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[rank < k]


class Lists:
    """The best k candidates so far of each query of one matrix; a smaller key is better."""

    def __init__(self, n: int, k: int, dtype) -> None:
        self.n, self.k = n, k
        self.query, self.ids, self.keys = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)

    def add(self, query: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        query, ids, keys = np.concatenate([self.query, query]), np.concatenate([self.ids, ids]), np.concatenate([self.keys, keys])
        best = merge(ids, keys, self.k, self.n, query)
        self.query, self.ids, self.keys = query[best], ids[best], keys[best]

    def worst(self) -> np.ndarray:
        """The k-th key of each query; the largest number where there are fewer."""
        count = np.bincount(self.query, minlength=self.n)
        out = np.full(self.n, np.inf)
        full = count == self.k
        out[full] = self.keys[(np.cumsum(count) - 1)[full]]
        return out


class _Block:
    """The queries of a cell: for each dimension and band, one prepared matrix for each tile's worth, and its lists."""

    def __init__(self, parts: list[pa.RecordBatch], k: int, dtype, prepare: Callable) -> None:
        held: dict[tuple[int, int], list] = {}
        for part in parts:
            for dim, band, ids, x in matrices(part):
                held.setdefault((dim, band), []).append((ids, x))
        self.by: dict[int, list[tuple[dict, Lists]]] = {}
        for (dim, band), found in held.items():
            ids, x = (np.concatenate(v) for v in zip(*found, strict=True))
            for a in range(0, len(ids), BLOCK):
                q = prepare(ids[a : a + BLOCK], x[a : a + BLOCK], band)
                self.by.setdefault(dim, []).append((q, Lists(len(q["ids"]), k, dtype)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        for q, kept in (x for found in self.by.values() for x in found):
            yield pa.RecordBatch.from_arrays([pa.array(q["ids"][kept.query]), pa.array(kept.ids), pa.array(kept.keys)], ["query_id", "vec_id", "key"])


def _cells(k: int, tile: Callable, prepare: Callable, dtype):
    """Multiply the cells of a partition, which come one after another, each with its queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_thread()
        now, asked, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, shard = (batch.column(c).to_numpy() for c in ("cell", "side"))
            cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (shard[1:] != shard[:-1])) + 1), len(cell)]
            for i, j in pairwise(cuts):
                part = batch.slice(i, j - i)
                if cell[i] != now:
                    if block:
                        yield from block.rows()
                    now, asked, block = cell[i], [], None
                if not shard[i]:
                    asked.append(part)
                    continue
                if block is None:
                    block, asked = _Block(asked, k, dtype, prepare), []
                for dim, band, ids, x in matrices(part):
                    if dim in block.by:
                        candidates = prepare(ids, x, band)
                        for q, lists in block.by[dim]:
                            tile(q, candidates, lists)
        if block:
            yield from block.rows()

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int, tile: Callable, prepare: Callable, key_type: str) -> DataFrame:
    """(query_id, rank, vec_id, key): the k smallest keys of each query among vectors of its dimension.

    ``prepare(ids, x, band)`` makes what a tile needs of a matrix; ``tile(queries, shard, lists)`` adds the
    candidates that a tile finds.
    """
    # Of rows that share a vec_id the smallest vector is asked for. More than k equal rows would fill no list anew.
    asked = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("copies", F.lit(1))
    different = vectors.groupBy("vec_id", "embedding").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    size = lambda df, more: int(df.agg(F.coalesce(F.sum(F.size("embedding").cast("long") * 8 + more), F.lit(0))).first()[0])
    blocks = max(1, -(-size(queries, 64 + 32 * k) // QUERY_BYTES))
    shards = max(-(-size(vectors, 64) // SHARD_BYTES), -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    cell = (F.col("block") * shards + F.col("shard")).cast("int").alias("cell")
    left = asked.select("vec_id", "embedding", "copies", place(blocks).alias("block"), every(shards).alias("shard")).select(cell, F.lit(0).alias("side"), "vec_id", "embedding", "copies")
    right = different.select("vec_id", "embedding", "copies", place(shards).alias("shard"), every(blocks).alias("block")).select(cell, F.lit(1).alias("side"), "vec_id", "embedding", "copies")
    both = left.union(right).repartitionById(blocks * shards, F.col("cell")).sortWithinPartitions("cell", "side")
    found = both.mapInArrow(_cells(k, tile, prepare, np.int64 if key_type == "long" else np.float64), f"query_id long, vec_id long, key {key_type}")
    order = Window.partitionBy("query_id").orderBy("key", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "key")
