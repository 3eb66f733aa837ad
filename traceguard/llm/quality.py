"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space.

A text's features are counts of hashed byte trigrams, of word shapes (case, length, what the word ends with), of
pairs of neighbouring shapes, and of repetition (words equal to the one before, the share of different words).
The weighted counts of a bounded sample of labelled documents are factored by a truncated singular value
decomposition, and the documents' latent vectors are broadcast with their labels. Every document is projected
into that space and its cosine with every labelled vector is computed in blocks by matrix products; the
``NEIGHBOURS`` most similar ones vote, weighted by similarity.

Cases: a null or empty text, one without words, and every text if nothing is labelled 0 or 1, get the share of
label 1 among the labelled documents (0.5 without any). Texts are read whole. Labels that are null or not 0 or 1
and labels without a document are passed over; of repeated labels for a doc_id each counts. A null doc_id is
never held out. Repeated rows are scored one by one. The sample and the model depend on the rows, not on their order.
Further columns named in ``keep`` are passed through, but for one named like the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import carried, held_out, released, table
from .kernels import Words, give_back, groups, mix, own_thread, strings

#: Labelled documents that are broadcast: about so many, at most twice as many.
SAMPLE = 4096
RANK, NEIGHBOURS = 64, 25
TRIGRAMS, SHAPES, PAIRS, SHARES = 2048, 512, 512, 8
DIMS = TRIGRAMS + SHAPES + PAIRS + SHARES
#: A vote's weight is the similarity to this power: close neighbours count most.
SHARPNESS = 8
#: Documents whose features are held at once.
BLOCK = 512

#: Byte classes: 0 other ASCII sign, 1 lower case, 2 upper case, 3 digit, 4 beyond ASCII, 5 full stop or comma.
_CLASS = np.zeros(256, np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[44, 46]] = 5


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, DIMS) weighted features; all zero without words."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMS), np.float32)
    words = Words(data, offsets, lower=False)
    if not len(words):
        return out
    doc, h, first = words.doc(), words.hashes(), words.first
    count = np.diff(first)

    code = data.astype(np.uint32)
    gram = ((code[:-2] << 16 | code[1:-1] << 8 | code[2:]) * np.uint32(0x9E3779B1) >> np.uint32(21)).astype(np.int64) if len(code) > 2 else np.zeros(0, np.int64)
    for d in range(n):
        a, b = offsets[d], offsets[d + 1] - 2
        if b > a:
            out[d, :TRIGRAMS] = np.bincount(gram[a:b], minlength=TRIGRAMS)

    last = words.end - 1
    size = words.end - words.start
    kinds = _CLASS[data]
    shape = kinds[words.start] * np.uint64(6) + kinds[last]
    shape = shape * np.uint64(6) + kinds[np.maximum(last - 1, words.start)]
    shape = shape * np.uint64(6) + kinds[np.minimum(words.start + 1, last)]
    # Signs at a word's end by their byte, letters and digits by their class only.
    ending = np.where((kinds[last] == 0) | (kinds[last] == 5), data[last], 0).astype(np.uint64)
    shape = mix((shape * np.uint64(256) + ending) * np.uint64(8) + np.minimum(size // 4, 7).astype(np.uint64))
    at = doc * SHAPES + (shape % np.uint64(SHAPES)).astype(np.int64)
    out[:, TRIGRAMS : TRIGRAMS + SHAPES] = np.bincount(at, minlength=n * SHAPES).reshape(n, SHAPES)

    inner = doc[1:] == doc[:-1]
    pair = (mix(shape[:-1] * np.uint64(3) + shape[1:]) % np.uint64(PAIRS)).astype(np.int64)
    at = (doc[1:] * PAIRS + pair)[inner]
    out[:, TRIGRAMS + SHAPES : TRIGRAMS + SHAPES + PAIRS] = np.bincount(at, minlength=n * PAIRS).reshape(n, PAIRS)

    for start, width in ((0, TRIGRAMS), (TRIGRAMS, SHAPES), (TRIGRAMS + SHAPES, PAIRS)):
        block = out[:, start : start + width]
        np.log1p(block, out=block)
        block /= np.maximum(np.sqrt((block**2).sum(1, keepdims=True)), 1e-9)

    repeats = np.bincount(doc[1:], weights=inner & (h[1:] == h[:-1]), minlength=n)
    distinct = np.array([len(np.unique(h[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)])
    shares = out[:, -SHARES:]
    full = np.maximum(count, 1)
    shares[:, 0] = np.sqrt(repeats / full)
    shares[:, 1] = np.clip(1 - distinct / full, 0, 1)
    shares[:, 2] = np.sqrt(np.bincount(doc, weights=(kinds[words.start] == 2) & (kinds[np.minimum(words.start + 1, last)] == 2), minlength=n) / full)
    shares[:, 3] = np.sqrt(np.bincount(doc, weights=kinds[last] == 0, minlength=n) / full)
    shares[:, 4] = 1 / (1 + count / 8)
    shares *= 0.7
    out[count == 0] = 0
    return out


def _featured(docs: DataFrame) -> DataFrame:
    """(nr, doc_id, quality, features): one binary of float32 for each document."""
    names = ("nr", "doc_id", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for a, b in groups(offsets):
                for i in range(a, b, BLOCK):
                    j = min(i + BLOCK, b)
                    x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    part = batch.slice(i, j - i)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([v.tobytes() for v in x], pa.binary())], [*names, "features"])

    return docs.select(*names, "text").mapInArrow(run, "nr long, doc_id long, quality int, features binary")


@dataclass
class Model:
    weights: np.ndarray  # of features
    basis: np.ndarray  # (DIMS, RANK)
    vectors: np.ndarray  # labelled documents, of length 1
    labels: np.ndarray
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        latent = (x * self.weights) @ self.basis
        return latent / np.maximum(np.sqrt((latent**2).sum(1, keepdims=True)), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Votes for label 1 of each row's nearest labelled documents; the prior for rows of zeros."""
        out = np.full(len(x), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        similar = self.project(x) @ self.vectors.T
        if similar.shape[1] > k:
            near = np.argpartition(-similar, k - 1, axis=1)[:, :k]
        else:
            near = np.tile(np.arange(similar.shape[1]), (len(x), 1))
        weight = np.clip(np.take_along_axis(similar, near, 1), 1e-6, 1).astype(np.float64) ** SHARPNESS
        vote = (weight * self.labels[near]).sum(1) / weight.sum(1)
        some = x.any(1)
        out[some] = np.clip(vote[some], 0, 1)
        return out


def train(x: np.ndarray, labels: np.ndarray) -> Model:
    """Latent vectors by a randomised truncated SVD (Halko, Martinsson and Tropp, 2011)."""
    some = x.any(1)
    prior = float(labels.mean()) if len(labels) else 0.5
    x, labels = x[some], labels[some].astype(np.float64)
    held = (x > 0).sum(0)
    weights = np.log((len(x) + 1) / (held + 1)).astype(np.float32) * 0.5 + 0.5
    weights[-SHARES:] = 1
    if not len(x):
        return Model(weights, np.zeros((DIMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, prior)
    y = x * weights
    rng = np.random.default_rng(7)
    sketch = y @ rng.standard_normal((DIMS, RANK + 16)).astype(np.float32)
    for _ in range(3):
        sketch = y @ (y.T @ np.linalg.qr(sketch)[0])
    q = np.linalg.qr(sketch)[0]
    basis = np.linalg.svd(q.T @ y, full_matrices=False)[2][:RANK].T.astype(np.float32)
    model = Model(weights, np.ascontiguousarray(basis), np.zeros((0, 1), np.float32), labels, prior)
    model.vectors = model.project(x).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on a bounded sample, chosen by a hash of doc_id, of ``labels`` (doc_id, quality) that have a document."""
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    share = min(1.0, SAMPLE / max(1, labels.count()))
    nr = F.xxhash64("doc_id", F.lit("quality"))
    chosen = labels.where(F.pmod(nr, F.lit(1 << 30)) / F.lit(float(1 << 30)) < share).orderBy(nr, "doc_id", "quality").limit(2 * SAMPLE)  # so few that they can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("nr", F.xxhash64("doc_id", "quality", "text"))
    order = ["nr", "doc_id", "quality"]
    got = _featured(rows).orderBy(*order).limit(2 * SAMPLE).toArrow().sort_by([(c, "ascending") for c in order])
    x = np.frombuffer(b"".join(got.column("features").to_pylist()), np.float32).reshape(-1, DIMS)
    return train(x, got.column("quality").to_numpy())


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` (text, ...) and score, the weighted share of votes for label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept, packed, own = carried(docs, keep, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_thread()
        m = sent.value
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            parts = [np.zeros(0)]
            for a, b in groups(offsets):
                for i in range(a, b, BLOCK):
                    j = min(i + BLOCK, b)
                    parts.append(m.scores(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
            yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(np.concatenate(parts))], ["own", "score"])
        give_back()

    return released(packed.select("own", "text").mapInArrow(run, StructType([own, StructField("score", DoubleType())])), kept, "score")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 4, 2))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 4, 2))
    scored = score(docs, fit(docs.where("not held_out"), labels), ("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
