"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import ann, jaccard, langid, linededup, lm, mixing, quality, sentencepiece_codec, topk, urlfilter

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.query,
    "op2_source_mixing": mixing.query,
    "op3_quality_votes": quality.query,
    "op4_log_bilinear_scores": lm.query,
    "op5_ngram_jaccard_join": jaccard.query,
    "op6_line_dedup": linededup.query,
    "op7_exact_top_k": topk.query,
    "op8_url_filter": urlfilter.query,
    "op9_language_id": langid.query,
    "op10_nearest_neighbours": ann.query,
}

ORACLES = {
    "op2_source_mixing": mixing.ORACLE,
    "op5_ngram_jaccard_join": jaccard.ORACLE,
    "op6_line_dedup": linededup.ORACLE,
    "op7_exact_top_k": topk.ORACLE,
    "op8_url_filter": urlfilter.ORACLE,
    "op10_nearest_neighbours": ann.ORACLE,
}
