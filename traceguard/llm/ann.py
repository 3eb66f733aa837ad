"""Nearest neighbours by a block matrix join over int8 tiles.

Query blocks and shards meet in cells (see ``tiles``). In a tile each vector stands as int8 codes, a scale, and
the norm of what the codes leave over. The codes are multiplied as float32 in slices of at most ``SLICE``
components, whose sums are whole numbers that float32 holds exactly, and added up as doubles; with the scales and
norms that bounds every distance from both sides, at any number of components. A pair survives if its lower bound
does not exceed the k-th smallest upper bound of its query, in the tile or so far. Survivors are computed again
from the original vectors in double precision and merged by heap-like lists of k. The bounds leave room for
their own rounding, so nothing is missed: recall is 1, and every row is searched.

Rows of very different magnitude never share a tile side, and a tile is scaled by a power of two before anything
is squared, so the bounds hold for vectors of any finite size.

Cases: vectors that are null, empty, all zero, or hold null or non-finite components take no part, as query or as
candidate; queries meet candidates of their own number of components only; with fewer than k candidates all are
returned. Equal distances are ordered by vec_id. Rows that share a vec_id are candidates one by one, but never for
a query of that vec_id, which is asked once (its smallest vector). A distance beyond the largest double is infinite.
Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .tiles import BAND, TILE_NUMBERS, Lists, search, usable

#: Relative room for the rounding of the bounds themselves, and absolute room, of a scaled tile, for underflow.
ROOM, LEAST = 1e-9, 1e-290
#: Components whose products of codes, each up to 127 * 127, add up to less than 2 ** 24.
SLICE = 1024


def _prepare(ids: np.ndarray, x: np.ndarray, band: int) -> dict:
    """Codes, norms and rests of the rows divided by 2 ** (BAND * band)."""
    y = np.ldexp(x, -BAND * band)
    scale = np.abs(y).max(axis=1) / 127
    code = np.rint(y / scale[:, None]).astype(np.int8)
    near = code.astype(np.float64) * scale[:, None]
    return {"ids": ids, "x": x, "band": band, "code": code.astype(np.float32), "scale": scale, "rest": np.sqrt(((y - near) ** 2).sum(1)), "norm": np.sqrt((near**2).sum(1)), "square": (y**2).sum(1)}


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of codes."""
    out = (a[:, :SLICE] @ b[:, :SLICE].T).astype(np.float64)
    for i in range(SLICE, a.shape[1], SLICE):
        out += a[:, i : i + SLICE] @ b[:, i : i + SLICE].T
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, components added in order.

    Where a square would be too large or too small for a double, the differences are scaled first.
    """
    with np.errstate(over="ignore", under="ignore"):
        gap = a - b
        most = np.abs(gap).max(axis=1, initial=0)
        power = np.where((most > 0) & (most < np.inf) & ((most > 1e150) | (most < 1e-150)), np.frexp(most)[1], 0)
        gap = np.ldexp(gap, -power[:, None])
        total = np.zeros(len(gap))
        for j in range(gap.shape[1]):
            total += gap[:, j] * gap[:, j]
        return np.ldexp(np.sqrt(total), power)


def _tile(k: int):
    def run(q: dict, shard: dict, lists: Lists) -> None:
        high_band = max(q["band"], shard["band"])
        f, g = (2.0 ** (BAND * max(-4, side["band"] - high_band)) for side in (q, shard))
        dot = _products(q["code"], shard["code"])
        dot *= (q["scale"] * f)[:, None] * (shard["scale"] * g)[None, :]
        # x = near + rest, so x.y differs from near.near by at most this:
        error = (q["norm"] * f)[:, None] * (shard["rest"] * g)[None, :] + (q["rest"] * f)[:, None] * ((shard["norm"] + shard["rest"]) * g)[None, :]
        sums = (q["square"] * f * f)[:, None] + (shard["square"] * g * g)[None, :]
        error += ROOM * sums + LEAST
        low, high = sums - 2 * (dot + error), sums - 2 * (dot - error)
        own = q["ids"][:, None] == shard["ids"][None, :]
        high[own] = np.inf
        bound = np.ldexp(lists.worst(), -BAND * high_band) ** 2 * (1 + ROOM) + LEAST
        if high.shape[1] > k:
            bound = np.minimum(bound, np.partition(high, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero((low <= bound[:, None]) & ~own)
        step = max(1, TILE_NUMBERS // q["x"].shape[1])
        for i in range(0, len(row), step):
            r, c = row[i : i + step], col[i : i + step]
            lists.add(r, shard["ids"][c], distances(q["x"][r], shard["x"][c]))

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors of each query and their distances.

    Both hold vec_id and embedding.
    """
    nonzero = F.exists("embedding", lambda v: v != 0)
    found = search(usable(vectors).where(nonzero), usable(queries).where(nonzero), k, _tile(k), _prepare, "double")
    return found.select("query_id", "rank", "vec_id", F.col("key").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda s, t: s + t)) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
