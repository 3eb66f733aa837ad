"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's byte n-grams (2 to 4 bytes, lower-cased, white space as one separator) are hashed into buckets; the mean
of their embeddings goes through a linear layer and a softmax. Embeddings and layer are trained in numpy by
stochastic gradient descent on a bounded sample of labelled texts, of which each task sends a bounded number of
n-grams, drawn from the whole text. For prediction both are multiplied out into one table of a few
numbers for each bucket, so a text costs one table row for each n-gram, and the documents are not shuffled.

The softmax's temperature and the score below which a prediction is rejected are calibrated on a part of the
sample that training doesn't see.

Cases: a null text and one without a letter get ``und``, score 0, rejected. Texts of any length are read whole.
Without any labelled row every text gets ``und``. Equal scores go to the language that sorts first. A null doc_id
is never held out. Repeated rows are learnt from once and predicted one by one; the sample depends on doc_id, text and
lang alone, not on the order of rows. Further columns named in ``keep`` are passed through, but for those named like a
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import carried, held_out, released, table
from .kernels import give_back, groups, let_go, strings

BUCKETS_LOG2 = 16
ORDERS = (2, 3, 4)
DIM = 16
#: The training sample: about so many documents in all and of one language, at most twice as many in all.
SAMPLE, SAMPLE_LANG = 6000, 1500
#: The n-grams of a document that are learnt from: so many are drawn from a longer text.
DRAWN = 2048
#: Texts are worked on in groups of so many bytes, each of which takes some hundred bytes of memory for a while.
GROUP_BYTES = 1 << 17
RESULTS = ("lang_pred", "score", "rejected")
UNDETERMINED = "und"
#: The share of right predictions on calibration texts that may be rejected, and the highest threshold.
REJECTED_SHARE, HIGHEST_THRESHOLD = 0.001, 0.5

_LETTER = regex.compile(r"\p{L}")
_CODE = np.arange(256, dtype=np.uint8)
_CODE[65:91] += 32
_CODE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0x20
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each order, the bucket of the n-gram at each byte; those that would leave a text get the last bucket."""
    code = _CODE[data]
    capital = np.flatnonzero(data[:-1] == 0xC3) + 1  # À to Þ in UTF-8
    capital = capital[(data[capital] >= 0x80) & (data[capital] <= 0x9E)]
    code[capital] += 0x20
    code = code.astype(np.uint32)
    total = code
    for n in range(2, max(ORDERS) + 1):
        total = total[: len(code) - n + 1] * np.uint32(256) + code[n - 1 :] if len(code) >= n else code[:0]
        if n in ORDERS:
            out = np.full(len(code), 1 << BUCKETS_LOG2, np.int64)
            x = total * _ODD[n - 2]
            x ^= x >> np.uint32(15)
            out[: len(total)] = (x * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKETS_LOG2)
            for j in range(1, n):
                out[offsets[1:][offsets[1:] - offsets[:-1] >= j] - j] = 1 << BUCKETS_LOG2
            yield out


def _has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    small = data | 0x20
    seen = np.concatenate([[0], np.cumsum((small >= 97) & (small <= 122), dtype=np.int64)])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    for i in np.flatnonzero(~out & (offsets[1:] > offsets[:-1])):
        out[i] = _LETTER.search(texts[int(i)].as_py()) is not None
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (buckets + 1, languages); the last row is zero
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean over each text's n-grams."""
        n, sizes = len(offsets) - 1, np.diff(offsets)
        total = np.zeros((n, len(self.langs)))
        full = np.flatnonzero(sizes > 0)
        count = np.zeros(n)
        for k, bucket in zip(ORDERS, subwords(data, offsets), strict=True):
            count += np.maximum(sizes - k + 1, 0)
            if len(full):
                total[full] += np.add.reduceat(self.table[bucket], offsets[full], axis=0, dtype=np.float64)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return softmax(self.logits(data, offsets) * self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _bags(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the buckets of its n-grams, in order of place; at most DRAWN, taken from all over the text."""
    every = list(subwords(data, offsets))
    for a, b in pairwise(offsets.tolist()):
        bucket = np.concatenate([x[a:b] for x in every])
        bucket = bucket[bucket < 1 << BUCKETS_LOG2].astype(np.uint16)
        if len(bucket) > DRAWN:
            rng = np.random.default_rng(zlib.crc32(data[a:b]))
            bucket = bucket[np.sort(rng.choice(len(bucket), DRAWN, replace=False))]
        yield bucket


def sample(docs: DataFrame) -> DataFrame:
    """A bounded sample of (nr, lang, bag): about the same number of each language, chosen by ``nr``, a hash of doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for a, b in groups(offsets, GROUP_BYTES):
                bags = [x.tobytes() for x in _bags(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("nr"), part.column("lang"), pa.array(bags, pa.binary())], ["nr", "lang", "bag"])
        give_back()

    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE).collect()}
    nr = F.xxhash64("doc_id", "text", F.lit("langid"))
    x = known.select(nr.alias("nr"), "lang", "text")
    if counts:
        each = max(1, min(SAMPLE_LANG, SAMPLE // len(counts)))
        cut = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, each / n))))
        x = x.where(F.pmod("nr", F.lit(1 << 30)) / F.lit(float(1 << 30)) < cut[F.col("lang")])
    # Copies of one row have one number: they count once.
    once = x.mapInArrow(run, "nr long, lang string, bag binary").groupBy("nr", "lang").agg(F.min("bag").alias("bag"))
    return once.orderBy("nr", "lang").limit(2 * SAMPLE)


def train(drawn: list[np.ndarray], langs: list[str], epochs: int = 4, rate: float = 0.3, most: int = 300, batch: int = 32) -> Model:
    """Fit embeddings and layer by SGD (Adagrad steps), then temperature and threshold.

    ``drawn``: buckets of each text's n-grams; ``most``: how many of them one step takes from a text.
    """
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros(((1 << BUCKETS_LOG2) + 1, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(1)
    bags = []
    for x in drawn:
        bucket, n = np.unique(x, return_counts=True)
        bags.append((bucket, (n / max(1, n.sum())).astype(np.float32)))
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(y))
    dev, fit = order[: len(y) // 6], order[len(y) // 6 :]
    embed = (rng.standard_normal((1 << BUCKETS_LOG2, DIM)) * 0.1).astype(np.float32)
    layer, bias = (rng.standard_normal((DIM, len(names))) * 0.1).astype(np.float32), np.zeros(len(names), np.float32)
    seen_embed, seen_layer = np.full(embed.shape, 1e-6, np.float32), np.full(layer.shape, 1e-6, np.float32)
    for _ in range(epochs):
        rng.shuffle(fit)
        for i in range(0, len(fit), batch):
            chosen = [d for d in fit[i : i + batch] if len(bags[d][0])]
            if not chosen:
                continue
            idx, doc = [], []
            for j, d in enumerate(chosen):
                bucket, weight = bags[d]
                idx.append((rng.choice(bucket, most, p=weight / weight.sum()) if len(bucket) > most else bucket).astype(np.int64))
                doc.append(np.full(len(idx[-1]), j))
            idx, doc = np.concatenate(idx), np.concatenate(doc)
            start = np.searchsorted(doc, np.arange(len(chosen)))
            size = np.bincount(doc)[:, None]
            mean = np.add.reduceat(embed[idx], start, axis=0) / size
            grad = softmax(mean @ layer + bias)
            grad[np.arange(len(chosen)), y[chosen]] -= 1
            back = (grad @ layer.T).astype(np.float32)
            g = mean.T @ grad / len(chosen)
            seen_layer += g**2
            layer -= (rate * g / np.sqrt(seen_layer)).astype(np.float32)
            bias -= (0.01 * grad.mean(0)).astype(np.float32)
            rows, inverse = np.unique(idx, return_inverse=True)
            part = np.zeros((len(rows), len(chosen)), np.float32)
            np.add.at(part, (inverse, doc), 1.0)
            step = (part / size.T.astype(np.float32)) @ back
            seen_embed[rows] += step**2
            embed[rows] -= rate * step / np.sqrt(seen_embed[rows])
    model = Model(names, np.vstack([embed @ layer, np.zeros((1, len(names)), np.float32)]), bias.astype(np.float64))
    if len(dev):
        logits = np.stack([weight @ model.table[bucket] + model.bias for bucket, weight in (bags[d] for d in dev)]).astype(np.float64)
        losses = {t: -np.log(softmax(logits * t)[np.arange(len(dev)), y[dev]] + 1e-12).mean() for t in (0.25, 0.5, 1, 2, 4, 8)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(logits * model.temperature)
        right = p.argmax(1) == y[dev]
        if right.any():
            model.threshold = float(min(HIGHEST_THRESHOLD, 0.9 * np.quantile(p.max(1)[right], REJECTED_SHARE)))
    return model


def fit(docs: DataFrame) -> Model:
    """Train on a bounded sample of ``docs`` (doc_id, text, lang)."""
    rows = sample(docs).toArrow().sort_by([("nr", "ascending"), ("lang", "ascending")])
    model = train([np.frombuffer(x.as_buffer(), np.uint16) for x in rows.column("bag")], rows.column("lang").to_pylist())
    del rows
    give_back()
    return model


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` (but none named like a result) with lang_pred, score and rejected."""
    kept, packed, own = carried(docs, keep, *RESULTS)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    inside = "text" in kept  # a kept text isn't sent a second time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from _predicted(sent.value, batches, inside)
        give_back()

    schema = StructType([own, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return released(packed.select("own", *(() if inside else ("text",))).mapInArrow(run, schema), kept, *RESULTS)


def _predicted(m: Model, batches: Iterable[pa.RecordBatch], inside: bool) -> Iterator[pa.RecordBatch]:
    """A batch for each group of texts: own, lang_pred, score and rejected. ``inside``: the texts are a field of own."""
    names = np.array([*m.langs, UNDETERMINED], dtype=object)
    for batch in batches:
        texts = batch.column("own").field("text") if inside else batch.column("text")
        data, offsets = strings(texts)
        for a, b in groups(offsets, GROUP_BYTES):
            part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            best, score = np.full(b - a, len(m.langs)), np.zeros(b - a)
            if m.langs:
                letter = _has_letter(texts.slice(a, b - a), part, cuts)
                p = m.probabilities(part, cuts)
                best, score = np.where(letter, p.argmax(1), len(m.langs)), np.where(letter, p.max(1), 0)
            rejected = (best == len(m.langs)) | (score < m.threshold)
            yield pa.RecordBatch.from_arrays([batch.column("own").slice(a, b - a), pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], ["own", *RESULTS])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 3, 1))
    model = fit(docs.where("not held_out"))
    return predict(docs, model, ("doc_id", "held_out"))
