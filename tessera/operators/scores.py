"""From a tagger's scores to tags: (image, idx, logit) with a vocabulary (idx, tag, category)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import sigmoid

#: Categories that take the threshold for characters; all others take the general one.
CHARACTER_LIKE = ("character", "copyright", "artist")


def named(scores: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds tag, category and probability; scores outside the vocabulary or without a name are dropped."""
    words = vocabulary.where("tag IS NOT NULL").select("idx", "tag", "category")
    return scores.join(words, "idx").withColumn("probability", sigmoid(F.col("logit")))


def above(rows: DataFrame, general: float, character: float, strict: bool = False) -> DataFrame:
    """Rows that reach their category's threshold, or exceed it."""
    least = F.when(F.col("category").isin(*CHARACTER_LIKE), character).otherwise(general)
    return rows.where(F.col("probability") > least if strict else F.col("probability") >= least)


def best(rows: DataFrame, category: str) -> DataFrame:
    """(image, tag, probability) of the highest score in a category, the lowest index on a tie."""
    top = F.max(F.struct("probability", (-F.col("idx")).alias("n"), "tag")).alias("t")
    return rows.where(F.col("category") == category).groupBy("image").agg(top).select("image", "t.tag", "t.probability")


def ranked(rows: DataFrame) -> DataFrame:
    """Adds place, from 1, by falling probability within image and category; ties by index."""
    order = Window.partitionBy("image", "category").orderBy(F.desc("probability"), "idx")
    return rows.withColumn("place", F.row_number().over(order))


def top(rows: DataFrame, k: int) -> DataFrame:
    return ranked(rows).where(F.col("place") <= k)


def tag_lists(rows: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """image and, by category, the names in order of falling probability; rating and quality give their best."""
    kept = above(rows, thresholds["general"], thresholds["character"])
    lists = kept.groupBy("image", "category").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("probability")).alias("p"), "idx", "tag"))).alias("tags")
    )
    names: Column = F.transform("tags", lambda t: t["tag"])
    return lists.select("image", "category", names.alias("tags"))
