"""Exact top-k search by integer inner product.

Components become floor(256 * x). Query blocks and shards meet in cells (see ``tiles``) and are multiplied tile by
tile; in each tile a partial selection keeps every score of at least the k-th best, and lists are merged in a tree:
tile, cell, query.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, as query or as
candidate; queries meet candidates of their own number of components only; with fewer than k candidates all are
returned, with none the query has no row. Equal scores are ordered by vec_id. Rows that share a vec_id are
candidates one by one, but never for a query of that vec_id, which is asked once (its smallest vector). A score
beyond 64 bits is held at the nearest 64-bit number. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tiles import Lists, search, usable

INT64 = np.iinfo(np.int64)


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as Python's whole numbers."""
    return np.array([[math.floor(v * 256) if abs(v) < 2.0**53 else int(v) * 256 for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _prepare(ids: np.ndarray, x: np.ndarray, band: int) -> dict:
    most = float(np.abs(x).max(initial=0)) * 256 + 1
    return {"ids": ids, "x": np.floor(x * 256.0) if most < 2.0**62 else x, "most": most}


def _products(q: dict, shard: dict) -> np.ndarray:
    """Exact inner products, held to 64 bits."""
    a, b = q["x"], shard["x"]
    most = q["most"] * shard["most"] * a.shape[1]  # bounds the sum of the terms' sizes
    if most < 2**53:
        return (a @ b.T).astype(np.int64)  # all partial sums are whole numbers that a double holds
    if most < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    a, b = (np.vectorize(int, otypes=[object])(side["x"]) if side["most"] < 2.0**62 else _whole(side["x"]) for side in (q, shard))
    return np.array([[max(INT64.min + 1, min(INT64.max, int(s))) for s in row] for row in a @ b.T], dtype=np.int64).reshape(len(a), len(b))


def _tile(k: int):
    def run(q: dict, shard: dict, lists: Lists) -> None:
        own = q["ids"][:, None] == shard["ids"][None, :]
        key = -_products(q, shard)
        key[own] = INT64.max
        if key.shape[1] > k:  # everything up to the k-th key, ties included
            bound = np.partition(key, k - 1, axis=1)[:, k - 1]
            chosen = (key <= bound[:, None]) & ~own
        else:
            chosen = ~own
        row, col = np.nonzero(chosen)
        lists.add(row, shard["ids"][col], key[row, col])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest scores of each query among ``vectors``.

    Both hold vec_id and embedding.
    """
    found = search(usable(vectors), usable(queries), k, _tile(k), _prepare, "long")
    return found.select("query_id", "rank", "vec_id", (-F.col("key")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
