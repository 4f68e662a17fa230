"""Dataset checks: hits in one long form (check, severity, key, detail), folded once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import captions as caption_rules
from ..functions import text
from . import neighbors, tags

SHORT = 20
LEAST_SIDE = 768
NARROW, WIDE = 0.4, 2.5
SEVERITY = {
    "image_integrity": "critical",
    "caption_quality": "critical",
    "duplicates": "high",
    "multiple_views": "high",
    "multi_person": "high",
    "low_resolution": "medium",
    "watermark_tags": "medium",
    "similar_images": "medium",
    "extreme_ar": "low",
}


def exact_duplicates(files: DataFrame, key: str, content: str) -> DataFrame:
    """(hash, files, copies) of contents that two files or more share; unreadable (null) ones are left out.

    Only digests are shuffled; a hot content is one partial row a task, and the keys of a group
    come in long form from ``duplicate_members``.
    """
    hashed = files.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.md5(F.col(content)).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("key").alias("first_key"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def duplicate_members(files: DataFrame, key: str, content: str) -> DataFrame:
    """(hash, key) of every file in a group of equal contents."""
    hashed = files.where(F.col(content).isNotNull()).select(F.col(key).alias("key"), F.md5(F.col(content)).alias("hash"))
    groups = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("hash")
    return hashed.join(groups, "hash", "left_semi")


def caption_issues(captions: DataFrame, key: str, body: str, refusals: Sequence[str] = vocab.REFUSAL_FLAT) -> DataFrame:
    """(key, type) of empty, short and refusing captions; short and refusing may both hold."""
    stripped = text.strip(F.coalesce(F.col(body), F.lit("")))
    types = F.when(stripped == "", F.array(F.lit("empty"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.char_length(stripped) < SHORT, "short"),
                F.when(F.size(text.keyword_hits(F.col(body), refusals)) > 0, "apology"),
            )
        )
    )
    return captions.select(F.col(key).alias("key"), F.explode(types).alias("type"))


def small_images(images: DataFrame, least: int = LEAST_SIDE) -> DataFrame:
    """(image, width, height, short_side) below the least short side; undecodable images are left out."""
    side = F.least("width", "height")
    return images.where(F.col("error").isNull() & (side < least)).select("image", "width", "height", side.alias("short_side"))


def odd_shapes(images: DataFrame, low: float = NARROW, high: float = WIDE) -> DataFrame:
    """(image, aspect_ratio, reason) outside the bounds, the ratio rounded to 3 places."""
    ratio = F.bround(F.col("width") / F.nullif(F.col("height"), F.lit(0)), 3)
    found = images.where(F.col("error").isNull()).select("image", ratio.alias("aspect_ratio"))
    reason = F.when(F.col("aspect_ratio") < low, "narrow").otherwise("wide")
    return found.where((F.col("aspect_ratio") < low) | (F.col("aspect_ratio") > high)).withColumn("reason", reason)


def person_hits(captions: DataFrame, key: str, body: str) -> DataFrame:
    """(key, person_count, matched_tag, risk); 1girl with 1boy counts as two where no other tag tells."""
    t = text.tokens(F.col(body))
    pair = F.array_contains(t, "1girl") & F.array_contains(t, "1boy")
    both = F.struct(F.lit(2).alias("person_count"), F.lit("1girl+1boy").alias("matched_tag"), F.lit("medium").alias("risk"))
    found = F.coalesce(tags.persons(t), F.when(pair, both))
    return captions.select(F.col(key).alias("key"), found.alias("p")).where("p IS NOT NULL").select("key", "p.*")


def tag_hits(captions: DataFrame, key: str, body: str, words: Sequence[str]) -> DataFrame:
    """(key, matched_tags) of captions with a tag of ``words``."""
    found = captions.select(F.col(key).alias("key"), tags.matches(text.tokens(F.col(body)), words).alias("matched_tags"))
    return found.where(F.size("matched_tags") > 0)


def caption_hits(captions: DataFrame, key: str, body: str) -> DataFrame:
    """Hits of all caption checks from one pass over the captions: (check, key, detail)."""
    t = F.col("_tokens")
    rows = captions.select(F.col(key).alias("key"), F.coalesce(F.col(body), F.lit("")).alias("body")).withColumn("_tokens", text.tokens(F.col("body")))
    stripped = text.strip(F.col("body"))
    empty = stripped == ""
    pair = F.array_contains(t, "1girl") & F.array_contains(t, "1boy")
    hit = lambda check, detail, cond: F.when(cond, F.struct(F.lit(check).alias("check"), detail.alias("detail")))
    layout, marks = tags.matches(t, vocab.LAYOUT_TAGS), tags.matches(t, vocab.WATERMARK_TAGS)
    found = F.array(
        hit("caption_quality", F.lit("empty"), empty),
        hit("caption_quality", F.lit("short"), ~empty & (F.char_length(stripped) < SHORT)),
        hit("caption_quality", F.lit("apology"), ~empty & (F.size(text.keyword_hits(F.col("body"), vocab.REFUSAL_FLAT)) > 0)),
        hit("multiple_views", F.get(layout, 0), F.size(layout) > 0),
        hit("multi_person", F.coalesce(tags.persons(t)["matched_tag"], F.lit("1girl+1boy")), tags.persons(t).isNotNull() | pair),
        hit("watermark_tags", F.get(marks, 0), F.size(marks) > 0),
    )
    return rows.select("key", F.explode(F.array_compact(found)).alias("h")).select("h.check", "key", "h.detail")


def summary(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """check, severity, total_checked, count and pct from (check, ...) hits and (check, total_checked)."""
    counted = hits.groupBy("check").agg(F.count(F.lit(1)).alias("count"))
    rows = totals.join(counted, "check", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    pct = F.bround(F.col("count") * 100 / F.greatest("total_checked", F.lit(1)), 1)
    return rows.select("check", F.coalesce(severity[F.col("check")], F.lit("info")).alias("severity"), "total_checked", "count", pct.alias("pct"))


def health(checks: DataFrame) -> DataFrame:
    """One row: health_score in [0, 100] and total_issues of high and critical checks."""
    weight = F.create_map(*[F.lit(x) for k, v in vocab.SEVERITY_WEIGHTS.items() for x in (k, float(v))])
    share = F.when(F.col("total_checked") > 0, F.least(F.col("count") / F.col("total_checked"), F.lit(1.0)))
    lost = F.coalesce(F.sum(weight[F.col("severity")] * share), F.lit(0.0))
    grave = F.sum(F.when(F.col("severity").isin("high", "critical"), F.col("count")).otherwise(0))
    return checks.agg(
        F.greatest(F.lit(0), F.bround(100 - lost).cast("int")).alias("health_score"), F.coalesce(grave, F.lit(0)).cast("long").alias("total_issues")
    )


def union(hits: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, hits)


def refusal_report(texts: DataFrame, body: str, **tiers) -> DataFrame:
    """level, texts and refused by level, from the tiered detector."""
    found = texts.select(text.refusal(F.coalesce(F.col(body), F.lit("")), **tiers).alias("r"))
    return found.groupBy(F.col("r.level").alias("level")).agg(F.count(F.lit(1)).alias("texts"), F.count_if("r.refused").alias("refused"))


def integrity_report(texts: DataFrame, body: str, keywords: Sequence[str]) -> DataFrame:
    """One row: texts, those in a whole fence, those not, and those with a keyword."""
    c = F.coalesce(F.col(body), F.lit(""))
    return texts.agg(
        F.count(F.lit(1)).alias("total_txt"),
        F.count_if(text.fence_folder_ok(c)).alias("ok"),
        F.count_if(~text.fence_folder_ok(c)).alias("failed"),
        F.count_if(F.size(text.keyword_hits(c, keywords)) > 0).alias("with_keyword"),
    )


def status_fold(statuses: DataFrame, column: str, mark: str = "✅") -> DataFrame:
    """One row: total and success, where a status opens with the mark."""
    return statuses.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.startswith(F.col(column), F.lit(mark))).alias("success"))


def split_summary(texts: DataFrame, body: str) -> DataFrame:
    """Texts by mode and confidence of the caption split, with those that have tags and a caption."""
    s = texts.select(caption_rules.split_caption(F.col(body)).alias("s"))
    return s.groupBy("s.mode", "s.confidence").agg(
        F.count(F.lit(1)).alias("texts"), F.count_if(F.col("s.tags_text") != "").alias("with_tags"), F.count_if(F.col("s.caption_text") != "").alias("with_caption")
    )


def split_counters(captions: DataFrame, images: DataFrame) -> DataFrame:
    """One row: what a split export of (stem, text) with images (stem, ext, file) writes.

    Texts split, with tags or a caption only, empty or else; originals rewritten to their tags;
    images that go into the tag and the caption dataset.
    """
    split = captions.select("stem", caption_rules.split_caption(F.col("text")).alias("s"))
    split = split.join(images.select("stem").distinct().withColumn("has_image", F.lit(True)), "stem", "left")
    tags_, told = F.col("s.tags_text") != "", F.col("s.caption_text") != ""
    empty, image = F.col("s.mode") == "empty", F.coalesce("has_image", F.lit(False))
    counters = {
        "split_success_count": tags_ & told,
        "tags_only_count": tags_ & ~told,
        "caption_only_count": told & ~tags_,
        "empty_count": ~tags_ & ~told & empty,
        "unclassified_count": ~tags_ & ~told & ~empty,
        "original_rewritten_count": tags_,
        "tag_dataset_written_count": tags_ & image,
        "caption_dataset_written_count": told & image,
    }
    return split.agg(F.count(F.lit(1)).alias("processed_txt_count"), *[F.count_if(c).alias(n) for n, c in counters.items()])


#: The checks of a full check and the toggle that each goes with.
CHECKS = {
    "image_integrity": "image_integrity",
    "duplicates": "duplicates",
    "low_resolution": "resolution",
    "extreme_ar": "aspect_ratio",
    "caption_quality": "caption_integrity",
    "multiple_views": "dangerous_tags",
    "multi_person": "dangerous_tags",
    "watermark_tags": "watermark_tags",
    "composition": "composition",
    "nsfw_ratio": "nsfw_ratio",
    "similar_images": "similar_images",
}


def full_check(
    images: DataFrame, captions: DataFrame, nsfw: Sequence[str], checks: Mapping[str, bool] | None = None, most: int = 10, keep: float = 0.3, least_kept: int = 2, bits: int = neighbors.HASH_BITS
) -> DataFrame:
    """check, severity, total_checked, count and pct of every check that is switched on.

    ``images`` (image, width, height, error, digest, hash) and ``captions`` (key, body); the hits
    of the four caption checks come from one pass over the captions, those of the image headers
    from one over the images. Duplicates count groups, similar images those that thinning takes.
    ``health`` folds the rows; nsfw_ratio and composition are for information and cost nothing.
    """
    on = [c for c, toggle in CHECKS.items() if (checks or {}).get(toggle, True)]
    side = F.least("width", "height")
    ratio = F.bround(F.col("width") / F.nullif(F.col("height"), F.lit(0)), 3)
    good = F.col("error").isNull()
    found = {"image_integrity": ~good, "low_resolution": good & (side < LEAST_SIDE), "extreme_ar": good & ((ratio < NARROW) | (ratio > WIDE))}
    named = lambda rows, check: rows.select(F.lit(check).alias("check"))
    hit = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in found.items()]))
    hits = [images.select(F.explode(hit).alias("check")), caption_hits(captions, "key", "body").select("check")]
    if "duplicates" in on:
        groups = images.where("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
        hits.append(named(groups, "duplicates"))
    if "nsfw_ratio" in on:
        hits.append(named(tag_hits(captions, "key", "body", nsfw), "nsfw_ratio"))
    if "similar_images" in on:
        groups = neighbors.similar(images.select(F.col("image").alias("id"), "hash"), most, bits)
        hits.append(named(neighbors.thin(groups, keep, least_kept).where("NOT keep"), "similar_images"))
    n = F.count(F.lit(1)).alias("n")
    of_images = ["image_integrity", "duplicates", "low_resolution", "extreme_ar", "similar_images"]
    listed = lambda names: F.explode(text.literals([c for c in names if c in on])).alias("check")
    totals = images.agg(n).select(listed(of_images), F.col("n").alias("total_checked")).unionByName(
        captions.agg(n).select(listed([c for c in CHECKS if c not in of_images]), F.col("n").alias("total_checked"))
    )
    return summary(union(hits), totals)
