"""Mixing sources to target weights by Poisson replication.

A source's rate is the mean number of times that one of its documents is to appear: its target share of the
output divided by its share of the input. A document's count is drawn by inverting the Poisson distribution of
that rate at a uniform number that a hash of the seed and the document gives, so the draw needs no state and is
the same in every run. Each document is exploded by its count, and the copies are dealt out and sorted by another
hash. That hash is uniform, so equal ranges of it are equal parts of the output: the global order needs no sampling
pass over the documents.

Cases: documents of a null source are a source of their own, written as null; a null text is mixed like an empty
one, and both like any other; a document is named by doc_id and text, so rows that share both draw the same count and
stand side by side, and rows without a doc_id differ by their text; sources that ``weights`` does not name get weight 0
and disappear; an empty table gives no rows. Columns named like the results are replaced, all others passed through.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, materialize, others, table

#: Rates are broadcast if they take up to so many bytes; beyond, they are joined by a shuffle with salt.
BROADCAST_BYTES = 4 << 20
SALTS = 64
RESULTS = ("copy", "rate", "position")


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the md5 of seed and parts."""
    return F.conv(F.substring(hashed(seed, *parts), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def hashed(seed: str, *parts: Column) -> Column:
    """The md5 of seed and parts as text; a null part counts as empty."""
    return F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def poisson_count(rate: Column, drawn: Column) -> Column:
    """The inverse of the distribution function of a Poisson variable: how many of its values at 0, 1, 2, ... are at most ``drawn``.

    Values are looked at up to where the function is 1 to 52 bits. Terms are summed through logarithms, so that
    large rates don't underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    below = lambda total: (total <= drawn).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), below(F.exp(-rate)).alias("count"))

    def add(s, k):
        log = s["log"] + F.log(rate) - F.log(k.cast("double"))
        total = s["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), (s["count"] + below(total)).alias("count"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, add)["count"]).otherwise(F.lit(0))


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, size: float) -> DataFrame:
    """(source_key, rate) for each source; counts cover all documents."""
    counts = docs.groupBy(F.col("source").alias("source_key")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(1 / temperature))
    elif weights:
        weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("source_key")].cast("double"), F.lit(0.0))
    else:
        raise ValueError("weights must name a source")
    counts = materialize(counts.withColumn("weight", weight), "sources")
    total = counts.agg(F.sum("n").alias("all_n"), F.sum("weight").alias("all_weight"))
    rates = counts.withColumns({"all_n": total.select("all_n").scalar(), "all_weight": total.select("all_weight").scalar()})
    rate = F.when(F.col("all_weight") > 0, F.col("weight") / F.col("all_weight") * F.col("all_n") * size / F.col("n")).otherwise(F.lit(0.0))
    return rates.select("source_key", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 2.0, size: float = 1.0, seed: str = "mix") -> DataFrame:
    """Copies of ``docs`` (doc_id, text, source, ...) in proportion to the weights.

    ``weights``: target share of each source (any scale); without them a source's share is its number of
    documents to the power 1 / temperature. ``size``: expected output rows as a multiple of the input.
    Adds copy (from 1), rate and position (a hash, in whose order ``shuffled`` puts the rows).
    """
    own = others(docs.columns, *RESULTS)
    rates = source_rates(docs.select("source"), weights, temperature, size)
    x = docs.select(F.struct(*map(column, own)).alias("own"), "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("name"))
    held = rates.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("source_key"), F.lit(0)) + 64), F.lit(0))).first()[0]
    if held <= BROADCAST_BYTES:
        x = x.join(F.broadcast(rates), x.source.eqNullSafe(rates.source_key))
    else:
        x = x.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)))
        salted = rates.withColumn("rate_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        x = x.join(salted, x.source.eqNullSafe(salted.source_key) & (x.salt == salted.rate_salt))
    x = x.withColumn("drawn", uniform(seed, F.col("own.doc_id"), F.col("name"))).withColumn("times", poisson_count(F.col("rate"), F.col("drawn"))).where("times > 0")
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return x.select(*(F.col("own")[c].alias(c) for c in own), F.col("copy").cast("long").alias("copy"), "rate", hashed(f"{seed}|order", F.col("own.doc_id"), F.col("name"), F.col("copy")).alias("position"))


def shuffled(mixed: DataFrame) -> DataFrame:
    """The rows in the order of ``position``, over as many partitions as ``spark.sql.shuffle.partitions`` says."""
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.conv(F.substring("position", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return mixed.repartitionById(parts, F.floor(place * parts).cast("int")).sortWithinPartitions("position")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return shuffled(mix_sources(docs)).select("doc_id", "source", "copy", "position", F.round("rate", 9).alias("rate"), "text")


ORACLE = r"""
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
  SELECT source, pow(n::DOUBLE, 0.5) / (SELECT sum(pow(n::DOUBLE, 0.5)) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts
), steps(source, rate, k, log_p, total) AS (
  SELECT source, rate, 0, -rate, exp(-rate) FROM rates
  UNION ALL SELECT source, rate, k + 1, log_p + ln(rate) - ln((k + 1)::DOUBLE), total + exp(log_p + ln(rate) - ln((k + 1)::DOUBLE))
  FROM steps WHERE k < ceil(rate + 12 * sqrt(rate) + 20)
), drawn AS (
  SELECT row_number() OVER () AS nr, doc_id, text, source, coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) AS name FROM documents
), times AS (
  SELECT nr, doc_id, text, name, d.source, any_value(rate) AS rate, count(*) AS n
  FROM drawn d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.total <= ('0x' || substr(md5('mix|' || name), 1, 13))::BIGINT::DOUBLE / pow(2, 52)
  GROUP BY nr, doc_id, text, name, d.source
)
SELECT doc_id, source, copy::BIGINT AS copy, md5('mix|order|' || name || '|' || copy::VARCHAR) AS position, round(rate, 9) AS rate, text
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM times)
"""
