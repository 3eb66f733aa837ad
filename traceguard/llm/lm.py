"""Language-model scores: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

Tokens are lower-cased words (A-Z) and one end of text. Their counts in all training documents are gathered by a
shuffle. The commonest tokens are outcomes of the neural model, as many as the square root of the vocabulary
(from ``SHORTLIST`` to ``MOST_SHORT``: three tables of outcomes by outcomes go to every Python worker); every other
token belongs to one of ``CLASSES`` classes by its last bytes, which are outcomes too, and within its class a token has its add-one share
of the class's count, one share being kept for tokens that training never saw. So the probabilities of all
training tokens and of one unknown token for each class add up to 1 after any context.

The model is the log-bilinear one of two preceding outcomes: the score of an outcome is the product of its vector
and a predicted vector, which is linear in the vectors of the context. Training contrasts tokens with noise drawn
from the unigram distribution. To score, the products of all contexts' and outcomes' vectors are taken at once,
one matrix for each position, and one more matrix product gives the normalisers of all pairs of contexts; a
token's normalised log-probability is then read from three tables.

Counts and neural model cover all training documents, which are read once, however many there are. They are dealt into
rounds by a hash, small rounds first, so that each document is in one round. In a round every task starts from the same parameters and trains on
its documents group by group; a shuffle adds up the tasks' parameters, and each row of them becomes the mean over the
tasks that touched it, weighted by how often they did. So what few partitions hold is not thinned out by the others.

Counts of tokens beyond the ``FREQUENT`` commonest, which are broadcast (16 bytes each), are joined by a shuffle on
the token. Tokens are named by 64-bit hashes of their bytes.

Cases: a null text counts as empty and has one token, its end; texts are read whole; without training documents
every outcome has the same probability; a null doc_id is never held out; repeated rows are scored one by one. Further
columns named in ``keep`` are passed through, but for those named like a result or ``row``.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import carried, held_out, materialize, released, table
from .kernels import Words, give_back, groups, mix, own_thread, strings

SHORTLIST, MOST_SHORT, CLASSES, DIM = 1000, 2048, 256, 48
#: Counts of so many commonest tokens go to all executors: 16 bytes each, 8 MB.
FREQUENT = 1 << 19
#: Shares of the training documents in the rounds, in 32nds.
ROUNDS = (1, 1, 2, 4, 8, 16)
#: A round has no more tasks than one for so many tokens (or one for each core): each task sends all parameters.
TOKENS_A_TASK = 1_000_000
#: Parameters are sent in so many parts.
PARTS = 256
#: A task adds up counts of at most so many different tokens before it passes them on.
HELD = 1 << 21
#: The name of the end of a text; words have hashes.
END = 0x1D0E5C3B2A490877
RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
#: Columns of a row on its way to the results; they stand behind the kept ones, which are held in a struct.
SUMS = ("n_tokens", "n_known", "base", "score", "token", "n")


@dataclass
class Stream:
    """The tokens of a group of documents, each document's words and then its end."""

    hash: np.ndarray
    group: np.ndarray  # class by the last bytes
    doc: np.ndarray
    first: np.ndarray  # position of each document's first token; one more at the end


def tokens(data: np.ndarray, offsets: np.ndarray) -> Stream:
    words = Words(data, offsets)
    h = words.hashes()
    last = words.data[words.end - 1].astype(np.uint64)
    before = np.where(words.end - words.start > 1, words.data[np.maximum(words.end - 2, 0)], 0).astype(np.uint64)
    group = (mix(last * np.uint64(256) + before) % np.uint64(CLASSES)).astype(np.int64)
    docs = words.docs
    n = np.diff(words.first) + 1
    first = np.concatenate([[0], np.cumsum(n)])
    ends = first[1:] - 1
    out, out_group = np.full(first[-1], END, np.uint64), np.zeros(first[-1], np.int64)
    place = np.ones(first[-1], bool)
    place[ends] = False
    out[place], out_group[place] = h, group
    return Stream(out, out_group, np.repeat(np.arange(docs), n), first)


class Index:
    """Positions of 64-bit names in a sorted list, found through a table of their leading bits."""

    def __init__(self, names: np.ndarray) -> None:
        self.names = names
        self.bits = max(1, int(len(names)).bit_length() + 1)
        lead = (names >> np.uint64(64 - self.bits)).astype(np.int64)
        self.start = np.searchsorted(lead, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.run = int(np.diff(self.start).max(initial=0))

    def find(self, x: np.ndarray) -> np.ndarray:
        """The position of each name, -1 where it is missing."""
        out = np.full(len(x), -1, np.int32)
        if not len(self.names):
            return out
        at = self.start[(x >> np.uint64(64 - self.bits)).astype(np.int64)]
        todo = np.arange(len(x))
        for _ in range(self.run):
            at_todo = np.minimum(at[todo], len(self.names) - 1)
            found = self.names[at_todo]
            hit = found == x[todo]
            out[todo[hit]] = at_todo[hit]
            todo = todo[found < x[todo]]
            at[todo] += 1
            todo = todo[at[todo] < len(self.names)]
            if not len(todo):
                break
        return out


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, klass, n) for all tokens of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            name, klass, n = (np.concatenate(x) for x in zip(*held, strict=True))
            unique, at, inverse = np.unique(name, return_index=True, return_inverse=True)
            return unique, klass[at], np.bincount(inverse, weights=n).astype(np.int64)

        def out(x) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2])], ["token", "klass", "n"])

        size = 0
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for a, b in groups(offsets):
                s = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                name, at, n = np.unique(s.hash, return_index=True, return_counts=True)
                held.append((name, s.group[at], n))
                size += len(name)
                if size > HELD:
                    held[:] = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out(held.pop())
                        size = 0
        if held:
            yield out(merged())

    return docs.select("text").mapInArrow(run, "token long, klass long, n long").groupBy("token").agg(F.min("klass").alias("klass"), F.sum("n").alias("n"))


@dataclass
class Model:
    """What is sent to the executors; all arrays have bounded sizes."""

    total: int  # N
    distinct: int  # V
    frequent: np.ndarray  # sorted names
    counts: np.ndarray  # of frequent
    outcome: np.ndarray  # of frequent: position in the shortlist or -1
    class_total: np.ndarray  # log10(N_class + V_class + 1)
    short: int = SHORTLIST  # outcomes that are tokens
    trained: int = 0  # tokens that the neural model was trained on
    near: np.ndarray | None = None  # (contexts, outcomes): last token
    far: np.ndarray | None = None  # the token before
    bias: np.ndarray | None = None
    log_z: np.ndarray | None = None  # (last, before)


def shortlist(distinct: int) -> int:
    """How many tokens are outcomes, by the number of different tokens."""
    return max(SHORTLIST, min(MOST_SHORT, math.isqrt(distinct)))


def _outcomes(stream: Stream, index: Index, outcome: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in the frequent list or -1, outcome) of each token."""
    at = index.find(stream.hash)
    short = np.where(at >= 0, outcome[at], -1) if len(outcome) else at
    return at, np.where(short >= 0, short, size + stream.group)


def _contexts(out: np.ndarray, first: np.ndarray, border: int) -> tuple[np.ndarray, np.ndarray]:
    """The outcomes one and two tokens back; before a text's first token stands its border."""
    one = np.concatenate([[border], out[:-1]])
    two = np.concatenate([[border, border], out[:-2]])[: len(out)]
    start = first[:-1]
    one[start] = border
    two[start] = border
    second = (start + 1)[start + 1 < first[1:]]
    two[second] = border
    return one, two


def distinct(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different values of ``x`` (0 to size - 1) in order, how often each occurs, and the place of each element's value."""
    n = np.bincount(x, minlength=size)
    values = np.flatnonzero(n)
    place = np.empty(size, np.int64)
    place[values] = np.arange(len(values))
    return values, n[values].astype(np.float32), place[x]


def summed(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ``rows`` (less than 32768) and the sums of their gradients, which are repeated if fewer than rows.

    The number of columns is even: two of them are added at a time, as one complex number.
    """
    order = np.argsort(rows.astype(np.int16), kind="stable")
    rows = rows[order]
    start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    if len(grad) < len(rows):
        order %= len(grad)
    return rows[start], np.add.reduceat(grad[order].view(np.complex64), start, axis=0).view(np.float32)


class Network:
    """The parameters, their sums of squared gradients (AdaGrad), and how many steps touched each row.

    source: vectors of contexts; target: vectors and biases of outcomes; turn: what predicts from the two contexts.
    """

    NAMES = ("source", "target", "turn")

    def __init__(self, noise: np.ndarray) -> None:
        rng = np.random.default_rng(3)
        s = len(noise)
        source = (rng.standard_normal((s + 1, DIM)) * 0.1).astype(np.float32)
        target = (rng.standard_normal((s, DIM)) * 0.1).astype(np.float32)
        bias = np.log(noise).astype(np.float32)
        eye = np.eye(DIM, dtype=np.float32)
        self.noise = noise
        self.params = {"source": source, "target": np.concatenate([target, bias[:, None]], 1), "turn": np.concatenate([eye, 0.5 * eye])}
        self.squares = {k: np.full(v.shape, 1e-4, np.float32) for k, v in self.params.items()}
        self.seen = {k: np.zeros(len(v), np.float32) for k, v in self.params.items()}

    def _move(self, name: str, rows: np.ndarray | slice, g: np.ndarray, rate: float) -> None:
        squares = self.squares[name][rows] + g * g
        self.squares[name][rows] = squares
        g *= rate
        g /= np.sqrt(squares)
        self.params[name][rows] -= g
        self.seen[name][rows] += 1

    def train(self, one: np.ndarray, two: np.ndarray, out: np.ndarray, rng: np.random.Generator, batch: int = 512, negatives: int = 256, rate: float = 0.08) -> None:
        """One pass of noise-contrastive estimation. The noise samples of a batch are shared by its tokens.

        A batch's products are taken once for each different context and each different noise sample, which counts as
        often as it was drawn.
        """
        source, target, turn = (self.params[k] for k in self.NAMES)
        cumulative = np.cumsum(self.noise)
        # Each token has `negatives` noise samples; weights keep the two sides' sums alike.
        odds = np.log(self.noise * negatives).astype(np.float32)
        order = rng.permutation(len(out))
        for i in range(0, len(order), batch):
            at = order[i : i + batch]
            w, n = out[at], len(at)
            drawn = np.minimum(np.searchsorted(cumulative, rng.random(negatives) * cumulative[-1]), len(self.noise) - 1)
            fake, half = distinct(drawn, len(self.noise))[:2]
            half = half[:, None] * np.float32(0.5)
            context, _, place = distinct(np.concatenate([one[at], two[at]]), len(source))
            x = source[context]
            # The guess, 1 for the bias, and a 0 for an even number of columns.
            guess = np.zeros((n, DIM + 2), np.float32)
            np.add((x @ turn[:DIM])[place[:n]], (x @ turn[DIM:])[place[n:]], out=guess[:, :DIM])
            guess[:, DIM] = 1
            t_true, t_false = target[w], target[fake]
            t_true[:, DIM] -= odds[w]
            t_false[:, DIM] -= odds[fake]
            # 1 / (1 + exp(-x)) is (1 + tanh(x / 2)) / 2; the division and the number of draws are left to the smaller factors.
            d_true = np.tanh(np.einsum("ij,ij->i", guess[:, : DIM + 1], t_true) * np.float32(0.5)) * np.float32(0.5) - np.float32(0.5)
            d_false = guess[:, : DIM + 1] @ (t_false * np.float32(0.5)).T
            np.tanh(d_false, out=d_false)
            d_false += 1
            d_guess = d_false @ (t_false[:, :DIM] * half)
            d_guess += d_true[:, None] * t_true[:, :DIM]
            rows, g = summed(np.concatenate([w, fake]), np.concatenate([d_true[:, None] * guess, d_false.T @ guess * half]))
            self._move("target", rows, g[:, : DIM + 1], rate)
            # Sums over the tokens with a context one back and two back; the others have none.
            rows, g = summed(np.concatenate([place[:n], place[n:] + len(context)]), d_guess)
            d = np.zeros((2 * len(context), DIM), np.float32)
            d[rows] = g
            near, far = d[: len(context)], d[len(context) :]
            g, g_turn = near @ turn[:DIM].T + far @ turn[DIM:].T, np.concatenate([x.T @ near, x.T @ far])
            self._move("source", context, g, rate)
            self._move("turn", slice(None), g_turn, rate)

    def sums(self) -> np.ndarray:
        """What tasks add up: for each row its steps, and parameters and squares times steps."""
        rows = (np.concatenate([n[:, None], self.params[k] * n[:, None], self.squares[k] * n[:, None]], 1) for k, n in self.seen.items())
        return np.concatenate([x.ravel() for x in rows])

    def take(self, total: np.ndarray) -> None:
        """Mean parameters and squares from the ``sums`` of all tasks; rows that no task touched stay."""
        start = 0
        for k, p in self.params.items():
            n, width = p.shape
            x = total[start : start + n * (1 + 2 * width)].reshape(n, -1)
            start += x.size
            at = np.flatnonzero(x[:, 0])
            mean = x[at, 1:] / x[at, :1]
            p[at], self.squares[k][at] = mean[:, :width], mean[:, width:]

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(near, far, bias) scores of contexts and outcomes."""
        source, target, turn = (self.params[k] for k in self.NAMES)
        return source @ turn[:DIM] @ target[:, :DIM].T, source @ turn[DIM:] @ target[:, :DIM].T, target[:, DIM]


def _train(sent, k: int):
    """A task's part of a round: (part, n, sums), n tokens told with the first part only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_thread()
        names, outcome, short, network = sent.value
        network, index, n = pickle.loads(pickle.dumps(network)), Index(names), 0
        rng = np.random.default_rng((3, k, TaskContext.get().partitionId()))
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for a, b in groups(offsets):
                s = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out = _outcomes(s, index, outcome, short)[1]
                network.train(*_contexts(out, s.first, short + CLASSES), out, rng)
                n += len(out)
        if n:
            parts = [x.tobytes() for x in np.array_split(network.sums(), PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([n] + [0] * (PARTS - 1)), pa.array(parts, pa.binary())], ["part", "n", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    n = dict.fromkeys(range(PARTS), 0)
    for batch in batches:
        for part, more, sums in zip(*(batch.column(c) for c in ("part", "n", "sums")), strict=True):
            x, k = np.frombuffer(sums.as_buffer(), np.float32), part.as_py()
            held[k] = held[k] + x if k in held else x.astype(np.float64)
            n[k] += more.as_py()
    for k, x in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([n[k]]), pa.array([x.tobytes()], pa.binary())], ["part", "n", "sums"])


def train(docs: DataFrame, names: np.ndarray, short: int, network: Network, total: int) -> int:
    """Train on all ``docs`` (doc_id, text), which have ``total`` tokens; the number of tokens read."""
    spark = docs.sparkSession
    order = np.argsort(names)
    share, schema = sum(ROUNDS), "part int, n long, sums binary"
    slot = F.pmod(F.xxhash64("doc_id", "text", F.lit("lm")), F.lit(share))
    trained = 0
    for k in range(len(ROUNDS) if total else 0):
        chosen = docs.where((slot >= sum(ROUNDS[:k])) & (slot < sum(ROUNDS[: k + 1]))).select("text")
        tasks = max(spark.sparkContext.defaultParallelism, total * ROUNDS[k] // (share * TOKENS_A_TASK))
        sent = spark.sparkContext.broadcast((names[order], order.astype(np.int32), short, network))
        added = chosen.coalesce(tasks).mapInArrow(_train(sent, k), schema).repartition("part").mapInArrow(_add, schema).toArrow().sort_by("part")
        if len(added):
            network.take(np.concatenate([np.frombuffer(x.as_buffer(), np.float64) for x in added.column("sums")]))
            trained += sum(added.column("n").to_pylist())
        sent.destroy()
    return trained


def normalisers(near: np.ndarray, far: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log of sum over outcomes of exp(near + far + bias), for all pairs of contexts, by one matrix product."""
    high_near, high_far = near.max(1, keepdims=True), far.max(1, keepdims=True)
    b = np.exp((far - high_far).astype(np.float64))
    out = np.empty((len(near), len(far)), np.float32)
    for i in range(0, len(near), 256):
        a = np.exp((near[i : i + 256] - high_near[i : i + 256] + bias).astype(np.float64))
        out[i : i + 256] = np.log(a @ b.T + 1e-300) + high_near[i : i + 256] + high_far.T
    return out


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(names, counts) of at most FREQUENT commonest tokens, commonest first.

    A histogram of the counts' logarithms (4032 bars at most) gives the least count that still fits, so nothing
    is sorted on one machine.
    """
    bar = F.floor(F.log2(F.col("n")) * 64)
    bars = sorted(((r.bar, r.tokens) for r in counts.groupBy(bar.alias("bar")).agg(F.count("*").alias("tokens")).collect()), reverse=True)
    least, held = np.inf, 0
    for b, tokens_in in bars:
        if (held := held + tokens_in) > FREQUENT:
            break
        least = b
    top = counts.where(bar >= F.lit(float(least))).select("token", "n").toArrow()
    name, n = top.column("token").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((name, -n))
    return name[order].view(np.uint64), n[order]


def fit(docs: DataFrame, counts: DataFrame) -> Model:
    """``docs``: training documents (doc_id, text); ``counts``: of all their tokens."""
    spark = docs.sparkSession
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    name, n = _frequent(counts)
    size = shortlist(distinct)
    outcome = np.full(len(name), -1, np.int32)
    outcome[:size] = np.arange(min(size, len(name)))
    short = spark.createDataFrame([(int(x),) for x in name[:size].view(np.int64)], "token long")
    rest = counts.join(F.broadcast(short), "token", "left_anti").groupBy("klass").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rest.collect():
        class_n[r.klass], class_v[r.klass] = r.n, r.v
    unigram = np.concatenate([np.pad(n[:size].astype(float), (0, max(0, size - len(n)))), class_n]) + 1
    order = np.argsort(name)
    model = Model(int(total), int(distinct), name[order], n[order], outcome[order], np.log10(class_n + class_v + 1), size)

    network = Network(unigram / unigram.sum())
    model.trained = train(docs, name[:size], size, network, model.total)
    near, far, bias = network.tables()
    # Outcomes that stand for no token get no probability.
    bias = bias + np.where(np.arange(len(bias)) < size, np.where(np.arange(len(bias)) < len(name), 0.0, -1e4), 0.0)
    model.near, model.far, model.bias = near.astype(np.float32), far.astype(np.float32), bias.astype(np.float32)
    model.log_z = normalisers(model.near, model.far, model.bias)
    give_back()
    return model


def _score(model_of):
    """A row for each document with its sums (token null), and one for each rare token of a document (own null)."""
    names = ["row", "own", *SUMS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model_of.value
        index = Index(m.frequent)
        log_count = np.log10(m.counts + 1.0)
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for a, b in groups(offsets):
                s = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at, out = _outcomes(s, index, m.outcome, m.short)
                one, two = _contexts(out, s.first, m.short + CLASSES)
                log_p = (m.near[one, out].astype(np.float64) + m.far[two, out] + m.bias[out] - m.log_z[one, two]) / np.log(10)
                known = at >= 0
                count = np.where(known, log_count[at], 0) if len(log_count) else np.zeros(len(at))
                klass = out >= m.short
                inside = np.where(klass, count - m.class_total[np.maximum(out - m.short, 0)], 0)
                start = s.first[:-1]
                docs = batch.slice(a, b - a)
                sums = [np.add.reduceat(x, start) for x in (known.astype(np.int64), count, log_p + inside)]
                none = pa.nulls(b - a, pa.int64())
                yield pa.RecordBatch.from_arrays([docs.column("row"), docs.column("own"), pa.array(np.diff(s.first)), *map(pa.array, sums), none, none], names)
                doc, name = s.doc[~known], s.hash[~known]
                if len(name):
                    order = np.lexsort((name, doc))
                    doc, name = doc[order], name[order]
                    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])]))
                    n = np.diff(np.append(new, len(name)))
                    rows = docs.column("row").take(pa.array(doc[new]))
                    empty = pa.nulls(len(new), docs.schema.field("own").type)
                    nulls = [pa.nulls(len(new), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([rows, empty, *nulls, pa.array(name[new].view(np.int64)), pa.array(n)], names)

    return run


def score(docs: DataFrame, counts: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` (row, text, ...), n_tokens, n_known, train_tokens, base_score, score.

    ``row`` names each row of ``docs``.
    """
    kept, packed, own = carried(docs, keep, *RESULTS, "row")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("row", LongType()), own, *(StructField(c, DoubleType() if c in ("base", "score") else LongType()) for c in SUMS)])
    flat = packed.select("row", "own", "text").mapInArrow(_score(sent), schema)
    flat = materialize(flat, "tokens")
    rare = flat.where("token is not null").select("row", "token", "n").join(counts.select("token", F.col("n").alias("c")), "token")
    rare = rare.groupBy("row").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("rare_sum"))
    whole = flat.where("token is null").drop("token", "n").join(rare, "row", "left")
    more = F.coalesce("rare_sum", F.lit(0.0))
    unit = float(np.log10(model.total + model.distinct + 1.0))
    return released(
        whole,
        kept,
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * unit).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", held_out("doc_id", 7, 2)).withColumn("row", F.monotonically_increasing_id())
    learned = docs.where("not held_out")
    counts = materialize(count_tokens(learned), "counts")
    return score(docs, counts, fit(learned, counts), ("doc_id", "held_out"))
