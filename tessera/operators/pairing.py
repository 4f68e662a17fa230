"""Pairs of images and captions by stem, and the set operations on their keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text
from .written import Written


def with_names(files: DataFrame, extensions: Sequence[str] | None = None) -> DataFrame:
    """Adds stem and lower-case ext to (file, ...), keeping only the given extensions."""
    named = files.withColumns({"stem": text.stem(F.col("file")), "ext": F.lower(text.extension(F.col("file")))})
    return named.where(F.col("ext").isin(*extensions)) if extensions else named


def one_image(images: DataFrame, order: Sequence[str] = vocab.IMAGE_EXTENSIONS) -> DataFrame:
    """One image a stem, the first by extension in ``order``, then by name."""
    rank = F.array_position(text.literals(order), F.col("ext"))
    return images.groupBy("stem").agg(F.min_by("file", F.struct(rank, "file")).alias("image"))


def with_image(captions: DataFrame, images: DataFrame) -> DataFrame:
    """All captions, each with its one image or null."""
    return captions.join(one_image(images), "stem", "left")


def paired(captions: DataFrame, images: DataFrame) -> DataFrame:
    """Captions that have an image."""
    return captions.join(images.select("stem"), "stem", "left_semi")


def unpaired(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct stems of ``left`` that ``right`` does not have."""
    return left.select("stem").distinct().join(right.select("stem"), "stem", "left_anti")


def all_images(captions: DataFrame, images: DataFrame) -> DataFrame:
    """Every image of every caption's stem."""
    return captions.join(images, "stem")


def with_caption_flag(images: DataFrame, captions: DataFrame) -> DataFrame:
    """All images with has_txt."""
    have = captions.select("stem").distinct().withColumn("has_txt", F.lit(True))
    return images.join(have, "stem", "left").withColumn("has_txt", F.coalesce("has_txt", F.lit(False)))


def folder_stats(images: DataFrame, captions: DataFrame) -> DataFrame:
    """One row: counts of files and of distinct stems that are paired or lack a peer.

    Both sides are folded to stems first, so one shuffle of stems is all that moves.
    """
    sides = images.select("stem", F.lit(1).alias("i"), F.lit(0).alias("c")).unionByName(
        captions.select("stem", F.lit(0).alias("i"), F.lit(1).alias("c"))
    )
    stems = sides.groupBy("stem").agg(F.sum("i").alias("i"), F.sum("c").alias("c"))
    count = lambda cond: F.count_if(cond)
    has_i, has_c = F.col("i") > 0, F.col("c") > 0
    return stems.agg(
        F.coalesce(F.sum("i"), F.lit(0)).alias("images"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("captions"),
        count(has_i & has_c).alias("paired"),
        count(has_i & ~has_c).alias("without_caption"),
        count(~has_i & has_c).alias("without_image"),
    )


def extension_histogram(files: DataFrame) -> DataFrame:
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("files"))


def layers(images: DataFrame, masks: DataFrame, names: Sequence[str]) -> DataFrame:
    """Images with the file of each layer of (image, layer, file), or null."""
    wide = masks.groupBy("image").pivot("layer", list(names)).agg(F.min("file"))
    return images.join(wide, "image", "left")


def first_candidate(bases: DataFrame, files: DataFrame, suffixes: Sequence[str]) -> DataFrame:
    """For each base, the first file that exists of base + suffix, in the order of the suffixes."""
    named = bases.select("base", F.posexplode(text.literals(suffixes)).alias("rank", "suffix"))
    named = named.withColumn("file", F.concat("base", "suffix")).join(files.select("file").distinct(), "file")
    return bases.join(named.groupBy("base").agg(F.min_by("file", "rank").alias("file")), "base", "left")


def image_of_mask(masks: DataFrame, images: DataFrame) -> DataFrame:
    """(stem, mask) with ``image``: the image of that stem, or the mask itself if there is none."""
    found = masks.join(one_image(images), "stem", "left")
    return found.withColumn("image", F.coalesce("image", "mask"))


def looked_up(items: DataFrame, by_hash: DataFrame, by_id: DataFrame) -> DataFrame:
    """(key, md5, post_id) with tags found by hash, else by id; both tables are keyed uniquely."""
    a = by_hash.select("md5", F.col("tags").alias("_a"))
    b = by_id.select("post_id", F.col("tags").alias("_b"))
    found = items.join(a, "md5", "left").join(b, "post_id", "left")
    return found.withColumn("tags", F.coalesce("_a", "_b")).drop("_a", "_b")


def placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``place``, from 1, in a total order over all rows.

    A range sort: the sorted rows are written, partitions are counted, and ids that rise by one
    within each give the rest. No task holds more than a range, and no range is cut twice.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    ranged = Written(spark, "placed").save(ranged, "ranged")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    counts = counts.select("_part", "_first", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_before"))
    place = F.col("_id") - F.col("_first") + F.col("_before") + 1
    return ranged.join(F.broadcast(counts), "_part").select(*rows.columns, place.alias("place"))


def in_order(files: DataFrame) -> DataFrame:
    """Adds ``place``, from 1, in natural order of the file names."""
    return placed(files.withColumn("_key", text.natural_key(F.col("file"))), [F.col("_key"), F.col("file")]).drop("_key")


def numbered(files: DataFrame, prefix: str, start: int = 1, pad: int = 0) -> DataFrame:
    """Plan of new names: prefix and running number in natural order; longer numbers are not cut."""
    rows = in_order(files.select("file"))
    number = (F.col("place") + (start - 1)).cast("string")
    padded = F.when(F.length(number) < pad, F.lpad(number, pad, "0")).otherwise(number)
    return rows.select("file", F.concat(F.lit(prefix), padded, text.extension(F.col("file"))).alias("new_file"))
