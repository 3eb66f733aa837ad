"""Line deduplication by overlapping windows of three lines.

Every run of three consecutive lines is hashed. A window whose hash occurs more than once in the corpus is kept
where it occurs first, in the order of (doc_id, line, md5 of the text), and removed elsewhere: the lines that any
removed window covers go. Windows, positions and counts are shuffled, texts are not, but for the documents that
lose lines: a bitmap of their hashed names, bounded by ``MOST_BITS``, tells which documents may be among them, and
the rest go straight to the result. A full bitmap only means that more texts are shuffled.

Cases: a null text stays null; an empty text is one empty line; texts of fewer than three lines lose nothing;
windows of blank lines only are passed over. Lines are compared as they are, bytes and trailing spaces included.
Rows that share both doc_id and text are one document written down repeatedly: they keep or lose the same lines.
Rows that share a doc_id but not the text are different documents. A null doc_id sorts before all others. Further
columns are passed through; columns named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, others, table

WINDOW = 3
#: Bits of the bitmap for each document that loses lines, and of the whole: 32 MB, which go to all executors.
BITS, MOST_BITS = 16, 1 << 28
#: Bits of one row of the bitmap, and of one of its words.
ROW_BITS, WORD_BITS = 8192, 64


def named(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lines) of the rows with a text; ``key`` names the text."""
    return docs.where("text is not null").select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), F.split("text", "\n", -1).alias("lines"))


def windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, key, line, one, two): one row for each window that holds any text, named by two hashes."""
    start = F.when(F.size("lines") >= size, F.sequence(F.lit(0), F.size("lines") - size))
    run = lambda i: [F.get("lines", i + F.lit(k)) for k in range(size)]
    hashes = F.transform(start, lambda i: F.struct(i.alias("line"), F.xxhash64(*run(i)).alias("one"), F.hash(*run(i)).alias("two"), (F.trim(F.concat(*run(i))) == "").alias("blank")))
    found = named(docs).select("doc_id", "key", F.explode(hashes).alias("w"))
    return found.where("not w.blank").select("doc_id", "key", "w.line", "w.one", "w.two")


def covered_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, key, covered): the lines of each document that later occurrences of windows cover, in order."""
    # A window is named by 96 bits: two hashes of the same three lines.
    found = windows(docs, size)
    place = F.struct("doc_id", "line", "key")
    first = found.groupBy("one", "two").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    first = materialize(first.select("one", "two", "first"), "windows")
    later = found.join(first, ["one", "two"]).where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line") == F.col("first.line")) & (F.col("key") == F.col("first.key"))))
    starts = later.groupBy("doc_id", "key").agg(F.collect_set("line").alias("starts"))
    lines = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1))))
    return starts.select("doc_id", "key", F.array_sort(F.array_distinct(lines)).alias("covered"))


def _spot(bits: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", "key"), F.lit(bits))


def _bitmap(rows: DataFrame, bits: int) -> DataFrame:
    """(part, words): the bits of the hashed names of ``rows`` (doc_id, key), ROW_BITS in a row."""
    spot, a_row = F.col("spot"), ROW_BITS // WORD_BITS
    word = (spot / WORD_BITS).cast("long")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(spot, F.lit(WORD_BITS)).cast("int"))
    words = rows.select(_spot(bits).alias("spot")).groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))
    rows = words.groupBy((F.col("word") / a_row).cast("long").alias("part")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod("word", F.lit(a_row)).cast("int"), "bits"))).alias("known"))
    return rows.select("part", F.transform(F.sequence(F.lit(0), F.lit(a_row - 1)), lambda i: F.coalesce(F.element_at("known", i), F.lit(0).cast("long"))).alias("words"))


def dedup_lines(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` cleaned and n_lines, n_removed (of the text as it was)."""
    own = others(docs.columns, "n_lines", "n_removed")
    covered = materialize(covered_lines(docs.select("doc_id", "text"), size), "covered")
    bits = max(ROW_BITS, min(MOST_BITS, -(-covered.count() * BITS // ROW_BITS) * ROW_BITS))
    bitmap = materialize(_bitmap(covered, bits), "bitmap")

    key = F.unhex(F.md5(F.col("text").cast("binary")))
    x = docs.select(F.struct(*map(column, own)).alias("own"), "doc_id", key.alias("key"))
    x = x.withColumn("spot", F.coalesce(_spot(bits), F.lit(0)))
    x = x.join(F.broadcast(bitmap), (x.spot / ROW_BITS).cast("long") == bitmap.part, "left")
    at = F.pmod("spot", F.lit(ROW_BITS))
    hit = F.getbit(F.get("words", (at / WORD_BITS).cast("int")), F.pmod(at, F.lit(WORD_BITS)).cast("int")) == 1
    x = x.select("own", "doc_id", "key", (F.coalesce(hit, F.lit(False)) & F.col("key").isNotNull()).alias("hit"))
    none = F.expr("cast(null as array<int>)").alias("covered")
    marked = x.where("hit").select("own", F.col("doc_id").alias("doc"), "key")
    few = marked.join(covered.withColumnRenamed("key", "covered_key"), F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("covered_key")), "left")
    x = x.where("not hit").select("own", none).union(few.select("own", "covered"))

    lines = F.split(F.col("own.text"), "\n", -1)
    text = F.when(F.col("covered").isNull(), F.col("own.text")).otherwise(F.array_join(_kept(lines, F.col("covered")), "\n"))
    count = F.when(F.col("own.text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    removed = F.when(F.col("covered").isNull(), F.lit(0)).otherwise(F.size("covered")).cast("long")
    field = lambda c: F.col("own")[c]
    return x.select(*(text.alias(c) if c.lower() == "text" else field(c).alias(c) for c in own), count.alias("n_lines"), removed.alias("n_removed"))


def _kept(lines: F.Column, covered: F.Column) -> F.Column:
    """Lines between the sorted covered positions: the gaps are sliced out of the text."""
    marks = F.concat(F.array(F.lit(-1)), covered, F.array(F.size(lines)))
    gaps = F.zip_with(F.slice(marks, 1, F.size(marks) - 1), F.slice(marks, 2, F.size(marks) - 1), lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.flatten(gaps)


def query(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "n_lines", "n_removed")


ORACLE = r"""
WITH docs AS (
  SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), win AS (
  SELECT doc_id, text, i AS line, l[i : i + 2] AS w FROM (SELECT doc_id, text, l, unnest(range(1, len(l) - 1)) AS i FROM docs)
  WHERE trim(array_to_string(l[i : i + 2], '')) <> ''
), ranked AS (
  SELECT doc_id, text, line, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS FIRST, line, md5(text)) AS n FROM win
), covered AS (
  SELECT DISTINCT doc_id, text, unnest([line, line + 1, line + 2]) AS line FROM ranked WHERE n > 1
), gone AS (SELECT doc_id, text, list(line) AS gone FROM covered GROUP BY doc_id, text),
every AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
SELECT d.doc_id,
  CASE WHEN gone IS NULL THEN d.text ELSE array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT list_contains(gone, i)], chr(10)) END AS text,
  coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM every d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND d.text = g.text
"""
