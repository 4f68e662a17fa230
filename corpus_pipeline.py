"""From raw documents to encoded training text: five stages, each written before the next reads it.

Every stage takes all rows that the one before it kept, whatever other columns they have, and
returns them with all their columns; only the last returns digests. An empty table stays empty
through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, mixing, ngram_join, quality
from tessera.llm.shared import Scratch, read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep.

    Null and empty texts have no words and go. Repeated rows are judged alike; null ids are
    judged like others, but no label names them.
    """
    return quality.keep_good(spark, docs, read_table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id; of repeated rows one, a null id only if there is no other."""
    return exact_dedup.drop_duplicates(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five words, similarity 0.8 or more): the smallest id.

    Rows without an id or without words have no near copies and stay; rows of one id go by
    their own texts.
    """
    return ngram_join.one_of_each(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source, the last one; a text without words is taken as often as its
    source's whole share says. Rows of one id share its copies.
    """
    return mixing.draw(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of the ids and of the text decoded from them; a row for each row, null text as empty."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("mix_sources", mix_sources),
    ("bpe_round_trip", encode),
]

#: Hashed likelihood ratios, components and pseudo-random rounding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
