"""Queries of the corpus operators and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, html_text, langid, mixing, ngram_join, periodic, quality, resharding, spelling, substrings, token_counts, url_lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": ngram_join.query,
    "op2_token_counts": token_counts.query,
    "op3_substring_dedup": substrings.query,
    "op4_mix_sources": mixing.query,
    "op5_url_lists": url_lists.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_language_id": langid.query,
    "op8_quality_rules": quality.query,
    "op9_html_text": html_text.query,
    "op10_bpe_round_trip": bpe.query,
    "op11_spelling_variants": spelling.query,
    "op12_reshard": resharding.query,
    "op13_periodic_runs": periodic.query,
}
ORACLE_SQL: dict[str, str] = {
    "op5_url_lists": url_lists.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op11_spelling_variants": spelling.SQL,
    "op12_reshard": resharding.SQL,
    "op13_periodic_runs": periodic.SQL,
}
