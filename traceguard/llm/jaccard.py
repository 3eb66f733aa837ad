"""N-gram Jaccard join by parity sketches.

A document's set is its distinct k-word shingles, as 64-bit hashes. In a size band that allows d differing
shingles between two linked documents, the shingles are dealt into d + 1 blocks by hash, and the hashes of each
block are XORed: the parity sketch. A differing shingle changes one block only, so two linked documents agree in
at least one block (pigeonhole), and the Hamming distance of bit sketches is at most the symmetric difference.
Equal blocks give candidate pairs; the bit sketches refute most wrong ones; exact set intersection decides.

Links are only needed up to connectivity, so equal blocks are not expanded into all their pairs. Every member of
a block's bucket is first paired with the bucket's smallest member, and in buckets that are large and still hold
several components with other members in turn; at last pairs remain only between members of one bucket that lie in
different components.

What is counted of a bucket or a component is aggregated before it is shuffled. Then it is broadcast if it is small,
else written before it is joined, so that Spark can split a bucket or component that holds most rows.

A set goes by a 64-bit name; where a second hash shows that two sets share it, both get new names. Rows go by 128 bits.

Cases: a null or empty text and one without words have an empty set and are linked with nothing; fewer than k words
are one shingle. Rows that share a doc_id but not the text are documents of their own; repeated rows are equal
sets. A null doc_id is passed over where a component's smallest is looked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, table
from .components import beside, components
from .kernels import Words, give_back, groups, mix, shingles, strings

SKETCH_WORDS = 64
#: A linked pair is lost if all blocks that its differences leave untouched are weak. Weak blocks (few shingles)
#: are only left out of the join where that probability is below this, like a collision of hashes; 0 leaves out none.
LOSS = 1e-10
#: Buckets of up to FEW members are expanded by a join; larger ones are compared in chunks of about CHUNK members,
#: after TURNS of their members have been paired with all others.
FEW, CHUNK, TURNS = 8, 1000, 1
#: Bits of the bitmap of wanted rows for each of them, and of the whole as a power of two: 32 MB.
BITMAP_BITS, MOST_LOG2 = 16, 28


class Bands:
    """Size levels and, for each band of two neighbouring levels, the number of blocks."""

    def __init__(self, percent: int, loss: float = LOSS) -> None:
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent, self.loss, self.edges = percent, loss, [1]

    def level(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(self.edges[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def differences(self, total: int) -> int:
        """The largest symmetric difference of two linked sets of ``total`` elements together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def blocks(self, band: int) -> int:
        while len(self.edges) < band + 2:
            self.edges.append(self.edges[-1] * 100 // self.percent + 1)
        most = self.edges[band + 1] - 1
        return self.differences(most + most * 100 // self.percent) + 1


@lru_cache(maxsize=4096)
def least_shingles(blocks: int, percent: int, loss: float = LOSS) -> int:
    """How many shingles a block needs to take part in the join (0: even empty blocks do)."""
    if blocks < 8 or percent == 100:
        return 0
    if blocks > 200:  # the chance of a loss only falls with more blocks
        return least_shingles(200, percent, loss)
    hit = np.zeros(blocks + 1)  # distribution of touched blocks after blocks - 1 differences
    hit[0] = 1
    for _ in range(blocks - 1):
        stay = hit * np.arange(blocks + 1) / blocks
        stay[1:] += hit[:-1] * (blocks - np.arange(blocks)) / blocks
        hit = stay
    mean = percent / (100 - percent) / 2  # common shingles a block, at the least similarity
    weak, term = 0.0, np.exp(-mean)
    best = 0
    for t in range(1, 4):
        weak += term
        term *= mean / t
        if (hit[::-1] * weak ** np.arange(blocks + 1))[1:].sum() > loss:
            break
        best = t
    return best


def block_keys(shingle: np.ndarray, bands: Bands) -> list[np.ndarray]:
    """The join keys of one set: for its two bands, a hash of each block's number and parity."""
    level, out = bands.level(len(shingle)), []
    for band in (level, level - 1):
        if band < 0:
            continue
        m = bands.blocks(band)
        block = ((shingle >> np.uint64(33)) % np.uint64(m)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        count = np.bincount(block, minlength=m)
        parity = np.zeros(m, np.uint64)
        full = np.flatnonzero(count)
        parity[full] = np.bitwise_xor.reduceat(shingle[order], (np.cumsum(count) - count)[full])
        strong = np.flatnonzero(count >= least_shingles(m, bands.percent, bands.loss))
        out.append(mix(parity[strong] + mix(strong.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(band + 1))))
    return out


def bit_sketch(shingle: np.ndarray) -> np.ndarray:
    """SKETCH_WORDS * 64 parity bits of the whole set."""
    bit = (shingle & np.uint64(SKETCH_WORDS * 64 - 1)).astype(np.int64)
    odd = np.bincount(bit, minlength=SKETCH_WORDS * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def set_ids(shingle: np.ndarray) -> tuple[int, int]:
    """Two 64-bit names of the set itself; the second one is only compared."""
    n, total = np.uint64(len(shingle)), shingle.sum(dtype=np.uint64, keepdims=True)
    one = mix(mix(total) + np.bitwise_xor.reduce(shingle, keepdims=True) * np.uint64(3) + n)
    two = mix(mix(shingle ^ np.uint64(0x5DEECE66D5DEECE6)).sum(dtype=np.uint64, keepdims=True) + n)
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = strings(batch.column("text"))
    row = 0
    for a, b in groups(offsets):
        for s in shingles(Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), k):
            yield row, s
            row += 1


def _lists(parts: list[np.ndarray]) -> pa.Array:
    sizes = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat))


def _sketch(k: int, percent: int, loss: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent, loss), set()
        for batch in batches:
            n, node, second, keys = [], [], [], []
            for _, s in _sets(batch, k):
                n.append(len(s))
                one, two = set_ids(s) if len(s) else (None, None)
                node.append(one)
                second.append(two)
                if len(s) and (one, two) not in seen:  # a task sends the keys of equal sets once
                    if len(seen) < 1_000_000:
                        seen.add((one, two))
                    keys.append(np.unique(np.concatenate(block_keys(s, bands))))
                else:
                    keys.append(np.zeros(0, np.uint64))
            columns = [batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(second, pa.int64()), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_shingles", "node", "second", "keys"])
        give_back()

    return run


def _spots(row: pa.Array, log2_bits: int) -> np.ndarray:
    """Bit positions of 128-bit row names."""
    names = np.frombuffer(b"".join(x[:8] for x in row.to_pylist()), np.uint64)
    return (mix(names) & np.uint64((1 << log2_bits) - 1)).astype(np.int64)


def _members(k: int, wanted, log2_bits: int):
    """(row, sketch, shingles) of the documents, of those whose bit is set in ``wanted`` if there is such a broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if wanted is None else np.frombuffer(wanted.value, np.uint64)
        for batch in batches:
            if bitmap is not None:
                spot = _spots(batch.column("row"), log2_bits)
                batch = batch.filter(pa.array((bitmap[spot >> 6] >> (spot & 63).astype(np.uint64)) & np.uint64(1) == 1))
            sketch, sets, at = [], [], []
            for i, s in _sets(batch, k):
                if len(s):
                    at.append(i)
                    sketch.append(bit_sketch(s))
                    sets.append(s)
            for a in range(0, len(at), 1000):
                b = a + 1000
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(at[a:b], pa.int64())), _lists(sketch[a:b]), _lists(sets[a:b])], ["row", "sketch", "shingles"])
        give_back()

    return run


def _bitmap(rows: DataFrame, log2_bits: int) -> bytes:
    """Bits of the hashed row names, 2**log2_bits of them."""
    words = np.zeros(1 << (log2_bits - 6), np.uint64)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = _spots(batch.column("row"), log2_bits)
            yield pa.RecordBatch.from_arrays([pa.array(spot >> 6), pa.array(np.left_shift(np.uint64(1), (spot & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    grouped = rows.select("row").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for x in grouped.toLocalIterator():  # at most 2**MOST_LOG2 bits
        words[x.word] = np.uint64(x.bits & 0xFFFFFFFFFFFFFFFF)
    return words.tobytes()


def _wanted_sets(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(node, sketch, shingles) of ``rows`` (node, row), read again from the texts.

    A bitmap of the wanted rows saves the others the shuffle; where there are too many for it, a join does.
    """
    n = rows.count()
    schema = "row binary, sketch array<long>, shingles array<long>"
    if n * BITMAP_BITS // 2 <= 1 << MOST_LOG2:
        log2_bits = min(MOST_LOG2, max(16, (n * BITMAP_BITS).bit_length()))
        found = docs.mapInArrow(_members(k, docs.sparkSession.sparkContext.broadcast(_bitmap(rows, log2_bits)), log2_bits), schema)
    else:
        found = docs.join(rows.select("row"), "row", "left_semi").mapInArrow(_members(k, None, 0), schema)
    # Repeated rows give the same set again.
    return rows.join(found, "row").select("node", "sketch", "shingles").dropDuplicates(["node"])


def _one_name_a_set(sketched: DataFrame) -> DataFrame:
    """``sketched`` with new nodes where ``second`` shows that one stands for several sets.

    That is to be expected once in 4 billion sets, so the list of such nodes is short; it is joined all the same.
    """
    shared = sketched.where("node is not null").groupBy("node").agg(F.min("second").alias("low"), F.max("second").alias("high")).where("low < high")
    shared = materialize(shared.select("node", F.lit(True).alias("shared")), "collisions")
    if shared.isEmpty():
        return sketched
    return sketched.join(shared, "node", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("node", "second")).otherwise(F.col("node"))).drop("shared")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked."""
    size, bands = F.size, Bands(percent)
    for side in ("b", "a"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("sketch").alias(f"sketch_{side}"), F.col("shingles").alias(f"set_{side}")), side)
    total = size("set_a") + size("set_b")
    allowed = F.floor(total * (100 - bands.percent) / (100 + bands.percent))
    distance = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    common = size(F.array_intersect("set_a", "set_b"))
    return pairs.where(distance <= allowed).where(common * 100 >= (total - common) * percent).select("a", "b")


def _compare(percent: int, forest: bool):
    """Pairs of rows of one (key, lo, hi) whose parts differ and whose sketches don't refute a link.

    ``forest``: only as many pairs as would join the parts, if all of them turn out to be links.
    """

    def pairs(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, part, chunk, size = (group.column(x).to_numpy() for x in ("node", "part", "chunk", "size"))
        sketch = group.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(node), -1)
        one = np.flatnonzero(chunk == group.column("lo")[0].as_py())
        two = one if group.column("lo")[0] == group.column("hi")[0] else np.flatnonzero(chunk == group.column("hi")[0].as_py())
        a, b = [], []
        part = np.unique(part, return_inverse=True)[1]
        for i in range(0, len(one), 1 if forest else 64):
            x = one[i : i + (1 if forest else 64)]
            distance = np.zeros((len(x), len(two)), np.int32)
            for w in range(sketch.shape[1]):
                distance += np.bitwise_count(sketch[x, w][:, None] ^ sketch[two, w][None, :])
            close = distance <= (size[x][:, None] + size[two][None, :]) * (100 - percent) // (100 + percent)
            p, q = np.nonzero(close & (part[x][:, None] != part[two][None, :]))
            if forest and len(q):
                joined, at = np.unique(part[two[q]], return_index=True)
                p, q = p[at], q[at]
                part[np.isin(part, joined)] = part[x[0]]
            a.append(node[x[p]])
            b.append(node[two[q]])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        names = ("key", "lo", "hi")

        def flush():
            if held:
                a, b = pairs(pa.concat_tables(held))
                held.clear()
                both = np.unique(np.stack([a, b], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(x).to_numpy() for x in names], 1)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1), len(group)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if (now := tuple(group[i])) != last:
                    yield from flush()
                    last = now
                held.append(pa.Table.from_batches([batch.slice(i, j - i)]))
        yield from flush()

    return run


def _close_pairs(members: DataFrame, sets: DataFrame, percent: int, forest: bool = False) -> DataFrame:
    """Pairs of large buckets, compared by their sketches alone.

    A bucket is dealt into chunks of about CHUNK members and every two chunks meet in one group, so no task holds
    more than two chunks; only pairs that the sketches don't refute leave a task.
    """
    x = members.join(sets.select("node", "sketch", F.size("shingles").cast("long").alias("size")), "node")
    chunks = F.ceil(F.col("members") / CHUNK)
    x = x.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    x = x.select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "node", "part", "size", "sketch")
    x = x.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return x.mapInArrow(_compare(percent, forest), "a long, b long")


def _open_buckets(shared: DataFrame, found: DataFrame) -> DataFrame:
    """(key, node, part, members) of the buckets whose members lie in different components."""
    known = shared.select("key", "node").join(found.withColumnRenamed("root", "part"), "node", "left")
    known = materialize(known.select("key", "node", F.coalesce("part", "node").alias("part")), "known")
    spread = known.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("members")).where("low < high")
    spread = beside(spread.select("key", "members"), known.count())
    return materialize(known.join(spread, "key").select("key", "node", "part", "members"), "open")


def _stars(open_: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of one member of each bucket, another one in every turn, with those in other components."""
    hub = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "part")).alias("hub"))
    hub = beside(hub.select("key", F.col("hub.node").alias("hub"), F.col("hub.part").alias("hub_part")), open_.count())
    pairs = open_.join(hub, "key").where("part <> hub_part")
    return pairs.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def classes(docs: DataFrame, k: int = 5, percent: int = 80, loss: float = LOSS) -> DataFrame:
    """Rows of (row, doc_id, n_shingles, node, root): the class of each row of ``docs`` (row, doc_id, text).

    ``row`` is a 128-bit hash of doc_id and text, so that rows that share a doc_id stay apart. ``node`` names the
    set (equal sets share it) and ``root`` the component; both are null for a null or empty text and for one without
    words, which is linked with nothing. ``percent``: two documents link when 100 * intersection >= percent * union.
    ``loss``: the chance to miss a linked pair that is accepted for fewer candidates; with 0 none is missed.
    """
    with scratch(docs.sparkSession):
        docs = docs.select("row", "doc_id", "text")
        sketched = docs.mapInArrow(_sketch(k, percent, loss), "row binary, doc_id long, n_shingles long, node long, second long, keys array<long>")
        sketched = _one_name_a_set(materialize(sketched, "sketch"))

        keys = sketched.where("size(keys) > 0").select("node", F.explode("keys").alias("key"))
        hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
        shared = materialize(keys.join(materialize(hubs.select("key", "hub"), "hubs"), "key").select("key", "node", "hub").distinct(), "shared")

        stars = materialize(shared.where("hub < node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "stars")
        nodes = shared.select("node").distinct()
        rows = sketched.where("size(keys) > 0").select("node", "row").groupBy("node").agg(F.min("row").alias("row")).join(nodes, "node")
        sets = materialize(_wanted_sets(docs, materialize(rows, "rows"), k), "sets")

        links = materialize(_verify(stars, sets, percent), "links")
        found = components(links)

        # What is left: pairs in one bucket whose components differ. In large buckets other members become hubs in turn.
        # Then each node goes to one of its large buckets, the one with the smallest key, and only pairs that would join
        # components are tried there, as large buckets of near copies would bring up the same pairs again and again.
        # At last all buckets are gone through.
        tried, open_ = stars, _open_buckets(shared, found)
        for turn in range(TURNS + 1):
            large = open_.where(F.col("members") > FEW)
            if large.isEmpty():
                break
            if turn < TURNS:
                more = _stars(large, turn)
            else:
                once = large.groupBy("node").agg(F.min(F.struct("key", "part", "members")).alias("b")).select("node", "b.*")
                more = _close_pairs(once, sets, percent, forest=True).distinct()
            more = materialize(more.join(tried, ["a", "b"], "left_anti"), "more")
            tried, links = tried.union(more), materialize(links.union(_verify(more, sets, percent)), "links")
            open_ = _open_buckets(open_, components(links))
        few = open_.where(F.col("members") <= FEW)
        left, right = (few.select("key", F.col("node").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
        rest = left.join(right, "key").where("a < b and part_a <> part_b").select("a", "b")
        rest = rest.union(_close_pairs(open_.where(F.col("members") > FEW), sets, percent)).distinct()
        rest = materialize(rest.join(tried, ["a", "b"], "left_anti"), "rest")
        found = components(links.union(_verify(rest, sets, percent)))

        rows = sketched.select("row", "doc_id", "n_shingles", "node")
        full = rows.where("node is not null").join(found, "node", "left")
        full = full.select("row", "doc_id", "n_shingles", "node", F.coalesce("root", "node").alias("root"))
        return materialize(full.union(rows.where("node is null").select("row", "doc_id", "n_shingles", "node", F.lit(None).cast("long").alias("root"))), "classes")


def component_ids(classed: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id of each row's component; null ids are passed over."""
    full = classed.where("root is not null").select("root", "doc_id", "n_shingles")
    least = materialize(full.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    linked = full.join(least, "root").select("doc_id", "n_shingles", "component_id")
    return linked.union(classed.where("root is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def without_duplicates(docs: DataFrame, classed: DataFrame) -> DataFrame:
    """``docs`` (row, doc_id, ...) with one row, the first by (doc_id, row), of each component of ``classed``.

    Rows without words are all kept. Rows that share doc_id and text are one of the component's rows only once.
    """
    full = classed.where("root is not null").select("root", "row", "doc_id")
    first = full.groupBy("root").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    first = materialize(first.select("root", F.col("first.row").alias("kept")), "first")
    removed = materialize(full.join(first, "root").where("row <> kept").select("row").distinct(), "removed")
    repeated = full.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").join(removed, "row", "left_anti")
    repeated = materialize(repeated.select("row"), "repeated")
    left = docs.join(removed, "row", "left_anti")
    if repeated.isEmpty():
        return left
    return left.join(repeated, "row", "left_anti").unionByName(left.join(repeated, "row", "left_semi").dropDuplicates(["row"]))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row``, a name of doc_id and text that is the same in every reading, however files are split."""
    # A null text is told from an empty one by its lack of a second part.
    return docs.withColumn("row", F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text")).cast("binary"))))


def query(spark, sf_dir: str) -> DataFrame:
    return component_ids(classes(numbered(table(spark, sf_dir, "documents")), k=3, percent=90))


ORACLE = r"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, doc_id, text FROM documents
), words AS (
  SELECT nr, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM docs
), shingle AS (
  SELECT DISTINCT nr, array_to_string(w[i : least(i + 2, len(w))], ' ') AS s
  FROM (SELECT nr, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM words)
), sizes AS (SELECT nr, count(*) AS n FROM shingle GROUP BY nr),
pairs AS (
  SELECT x.nr AS a, y.nr AS b, count(*) AS common FROM shingle x JOIN shingle y ON x.s = y.s AND x.nr <> y.nr GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.nr = a JOIN sizes q ON q.nr = b WHERE 100 * common >= 90 * (p.n + q.n - common)
), reached(nr, other) AS (
  SELECT nr, nr FROM docs UNION SELECT r.nr, l.b FROM reached r JOIN links l ON l.a = r.other
), least_id AS (
  SELECT r.nr, min(o.doc_id) AS component_id FROM reached r JOIN docs o ON o.nr = r.other GROUP BY r.nr
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM docs d LEFT JOIN sizes USING (nr) JOIN least_id USING (nr)
"""
