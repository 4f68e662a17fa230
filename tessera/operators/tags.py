"""Tag inventories, vocabularies' matches and merges of tag lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text


def tag_rows(captions: DataFrame, key: str, body: str, plain: bool = False) -> DataFrame:
    """(key, ord, tag, tag_normalized) of the first paragraph's tags, in order; ``plain`` as in ``text.normal_tag``."""
    first = F.element_at(F.split(F.replace(F.col(body), F.lit("\r\n"), F.lit("\n")), "\n\n", 2), 1)
    rows = captions.select(F.col(key).alias("key"), F.posexplode(text.comma_list(first, plain)).alias("ord", "tag"))
    return rows.withColumn("tag_normalized", text.normal_tag(F.col("tag"), plain))


def inventory(captions: DataFrame, key: str, body: str, order: Column | None = None, plain: bool = False) -> DataFrame:
    """tag_normalized, tag (its first spelling by ``order`` of the keys) and count of distinct keys.

    Repeats within a caption fold before the shuffle by tag; a tag of a third of all captions
    is one partial row a task.
    """
    rows = tag_rows(captions, key, body, plain)
    first = F.struct((order if order is not None else F.col("key")).alias("order"), F.col("ord"))
    once = rows.groupBy("key", "tag_normalized").agg(F.min(F.struct(first.alias("at"), "tag")).alias("seen"))
    return once.groupBy("tag_normalized").agg(F.min("seen")["tag"].alias("tag"), F.count(F.lit(1)).alias("count"))


def inventory_keys(captions: DataFrame, key: str, body: str, plain: bool = False) -> DataFrame:
    """(tag_normalized, key) once each: the inverted index in long form."""
    return tag_rows(captions, key, body, plain).select("tag_normalized", "key").distinct()


def translate(tags: DataFrame, dictionary: DataFrame, column: str = "tag_normalized") -> DataFrame:
    """Adds zh from (tag, alias), '' where there is none. Spark picks the join by the sizes it knows."""
    named = dictionary.select(F.col("tag").alias(column), F.col("alias").alias("zh"))
    return tags.join(named, column, "left").withColumn("zh", F.coalesce("zh", F.lit("")))


def alias_dictionary(rows: DataFrame, position: str) -> DataFrame:
    """(tag, alias): the first comma part of each alias without quotes; the last row of a tag counts."""
    alias = F.regexp_replace(text.strip(F.element_at(F.split("alias", ","), 1)), '^"+|"+$', "")
    clean = rows.select(text.strip(F.col("tag")).alias("tag"), alias.alias("alias"), F.col(position).alias("at"))
    return clean.where("tag <> '' AND alias <> ''").groupBy("tag").agg(F.max_by("alias", "at").alias("alias"))


def matches(tokens: Column, words: Sequence[str]) -> Column:
    """Words of a vocabulary among the tokens, in vocabulary order; spellings must agree but for case."""
    return F.filter(text.literals(words), lambda w: F.array_contains(tokens, F.lower(w)))


def first_match(tokens: Column, words: Mapping[str, str]) -> Column:
    """What the first entry that matches stands for, or null."""
    found = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in words.items()]),
        lambda e: F.array_contains(tokens, F.lower(e["k"])),
    )
    return F.get(found, 0)["v"]


def persons(tokens: Column, words: Mapping[str, int] = vocab.PERSON_TAGS) -> Column:
    """struct(person_count, matched_tag, risk) by the largest count, null without one; from 3 on the risk is high."""
    entries = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(-i).alias("at"), F.lit(k).alias("tag")) for i, (k, n) in enumerate(words.items())])
    best = F.array_max(F.filter(entries, lambda e: F.array_contains(tokens, e["tag"])))
    risk = F.when(best["n"] >= 3, "high").otherwise("medium")
    return F.when(best.isNotNull(), F.struct(best["n"].alias("person_count"), best["tag"].alias("matched_tag"), risk.alias("risk")))


def composition(captions: DataFrame, body: str, words: Mapping[str, str] = vocab.COMPOSITION_TAGS) -> DataFrame:
    """Captions by composition; ``untagged`` where nothing matches."""
    label = F.coalesce(first_match(text.tokens(F.col(body)), words), F.lit("untagged"))
    return captions.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("captions"))


def share_with(captions: DataFrame, body: str, words: Sequence[str]) -> DataFrame:
    """One row: captions with a tag of ``words`` and their share in percent."""
    hit = F.size(matches(text.tokens(F.col(body)), words)) > 0
    total = F.greatest(F.count(F.lit(1)), F.lit(1))
    return captions.agg(
        F.count(F.lit(1)).alias("total_checked"), F.count_if(hit).alias("hits"), F.bround(F.count_if(hit) * 100 / total, 1).alias("pct")
    )


def merged(a: Column, b: Column) -> Column:
    """Sorted union of two lists, either of which may be missing."""
    none = text.literals(())
    return F.sort_array(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def sources_of(characters: DataFrame, mapping: DataFrame) -> DataFrame:
    """Sorted distinct ips of each image's characters, from (character, ip)."""
    return characters.join(mapping, "character").groupBy("image").agg(F.sort_array(F.collect_set("ip")).alias("ips"))
