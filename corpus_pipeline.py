"""A corpus from raw documents to tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceguard.llm import jaccard, langid, linededup, mixing, sentencepiece_codec
from traceguard.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates: five-word shingles, Jaccard similarity of 0.8 or more.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those that the classifier rejects go.

    The classifier learns from a bounded sample of documents with a language. A missing lang is filled in.
    """
    docs = docs.select(*COLUMNS)
    told = langid.predict(docs, langid.fit(docs), COLUMNS).where("not rejected")
    return told.select(*(F.coalesce("lang", "lang_pred").alias("lang") if c == "lang" else c for c in COLUMNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeated three-line windows cover; those that lose all their text go."""
    cleaned = linededup.dedup_lines(docs.select(*COLUMNS))
    kept = cleaned.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return kept.select(*(F.length("text").cast("long").alias("n_chars") if c == "n_chars" else c for c in COLUMNS))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near duplicates."""
    docs = jaccard.numbered(docs.select(*COLUMNS))
    classed = jaccard.classes(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    return jaccard.without_duplicates(docs, classed).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come closer to each other, in random order."""
    return mixing.shuffled(mixing.mix_sources(docs.select(*COLUMNS))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return sentencepiece_codec.encode(docs.select(*COLUMNS), keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("source_mixing", mix),
    ("sentencepiece", encode),
]

#: No SQL: the classifier is trained and the tokens come from a model file.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
