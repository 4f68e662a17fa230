"""Actions on files as plans to review: (src, dst, action). Nothing here changes a file of an input."""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import captions as caption_rules
from ..functions import text
from . import pairing
from .written import has_files


def _plan(rows: DataFrame, src: Column, dst: Column, action: str) -> DataFrame:
    return rows.select(src.alias("src"), dst.alias("dst"), F.lit(action).alias("action"))


def move_with_captions(hits: DataFrame, captions: DataFrame, folder: str) -> DataFrame:
    """Moves each image (image) of ``hits`` and the caption of its stem into a subfolder."""
    target = lambda c: F.concat(F.lit(f"{folder}/"), c)
    images = hits.select("image").distinct()
    peers = images.select(text.stem(F.col("image")).alias("stem")).distinct().join(captions.select("stem", "file"), "stem")
    return _plan(images, F.col("image"), target(F.col("image")), "move").unionByName(_plan(peers, F.col("file"), target(F.col("file")), "move"))


def retry_refused(refused: DataFrame, images: DataFrame, folder: str = "again") -> DataFrame:
    """Deletes refused captions (stem, file) and moves all images of their stems for another try."""
    gone = _plan(refused, F.col("file"), F.lit(None).cast("string"), "delete")
    peers = images.join(refused.select("stem").distinct(), "stem")
    return gone.unionByName(_plan(peers, F.col("file"), F.concat(F.lit(f"{folder}/"), F.col("file")), "move"))


def rename(images: DataFrame, captions: DataFrame, prefix: str, start: int = 1, pad: int = 0) -> DataFrame:
    """Renames images in natural order to prefix and number, captions after their images.

    Two phases by way of temporary names, so no new name meets an old one.
    """
    plan = pairing.numbered(images, prefix, start, pad)
    peers = plan.withColumn("stem", text.stem(F.col("file"))).join(captions.select("stem", F.col("file").alias("caption")), "stem")
    follow = peers.select(F.col("caption").alias("file"), F.concat(text.stem(F.col("new_file")), F.lit(".txt")).alias("new_file"))
    both = plan.unionByName(follow)
    temporary = F.concat(F.lit("__tmp__"), F.col("file"))
    first = both.select(F.lit(1).alias("phase"), F.col("file").alias("src"), temporary.alias("dst"), F.lit("rename").alias("action"))
    return first.unionByName(both.select(F.lit(2).alias("phase"), temporary.alias("src"), F.col("new_file").alias("dst"), F.lit("rename").alias("action")))


def split_export(captions: DataFrame, images: DataFrame, name: str) -> DataFrame:
    """(folder, file, text, image): tags under <name>-tag and captions under <name>-caption, each with its image to copy.

    A side that is empty for a caption has no row.
    """
    split = captions.select("stem", caption_rules.split_caption(F.col("text")).alias("s")).join(pairing.one_image(images), "stem", "left")
    side = lambda kind, column: split.where(F.col(f"s.{column}") != "").select(
        F.lit(f"{name}-{kind}").alias("folder"), F.concat("stem", F.lit(".txt")).alias("file"), F.col(f"s.{column}").alias("text"), "image"
    )
    return side("tag", "tags_text").unionByName(side("caption", "caption_text"))


def mask_name(prefix: str, person: Column, gender: Column, part: Column) -> Column:
    """File name of a person's part."""
    return F.concat(F.concat_ws("_", F.lit(prefix), person.cast("string"), gender, part), F.lit(".png"))


def export_files(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes (file, content) as one file a row into a folder of any file system that Arrow knows.

    A folder that has files is refused unless ``overwrite``. Each file is written under another
    name first, so a task that runs again leaves whole files; parquet is the sink for anything large.
    """
    system, path = fs.FileSystem.from_uri(folder)
    if not overwrite and has_files(rows.sparkSession, folder):
        raise FileExistsError(folder)
    system.create_dir(path, recursive=True)

    def write(part: Iterator) -> None:
        system, path = fs.FileSystem.from_uri(folder)
        for r in part:
            done = f"{path}/{r['file']}"
            with system.open_output_stream(f"{done}.part") as out:
                out.write(bytes(r["content"]))
            system.move(f"{done}.part", done)

    rows.select("file", F.coalesce("content", F.unhex(F.lit(""))).alias("content")).foreachPartition(write)


def export_texts(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Writes (stem, text) as one .txt file a row; null text makes an empty file."""
    export_files(rows.select(F.concat("stem", F.lit(".txt")).alias("file"), F.encode("text", "UTF-8").alias("content")), folder, overwrite)


def annotation_json(shapes: DataFrame) -> DataFrame:
    """(image, json) from (image, width, height, label, points): polygons numbered within the image."""
    shape = F.struct(
        F.col("label").alias("label"),
        F.col("points").alias("points"),
        F.lit("polygon").alias("shape_type"),
    )
    rows = shapes.groupBy("image", "width", "height").agg(F.sort_array(F.collect_list(shape)).alias("all"))
    numbered = F.transform(
        "all",
        lambda s, i: F.struct(
            s["label"].alias("label"),
            s["points"].alias("points"),
            (i + 1).alias("group_id"),
            s["shape_type"].alias("shape_type"),
            F.create_map().cast("map<string,boolean>").alias("flags"),
        ),
    )
    whole = F.struct(
        F.lit("1.0").alias("version"),
        F.create_map().cast("map<string,boolean>").alias("flags"),
        numbered.alias("shapes"),
        F.col("image").alias("imagePath"),
        F.lit(None).cast("string").alias("imageData"),
        F.col("height").alias("imageHeight"),
        F.col("width").alias("imageWidth"),
    )
    return rows.select("image", F.to_json(whole, {"ignoreNullFields": "false"}).alias("json"))


def report_json(parts: DataFrame) -> DataFrame:
    """(image, json) of a mask report from one row a part."""
    made = parts.groupBy("image", "width", "height").agg(
        F.map_from_entries(F.collect_list(F.struct("part", F.struct("count", "confidence", "has_detection", "mask_pixels", "mask_file")))).alias("parts")
    )
    whole = F.struct("image", F.struct("width", "height").alias("size"), "parts")
    return made.select("image", F.to_json(whole).alias("json"))


def png_base64(content: Column) -> Column:
    return F.base64(content)


def from_data_url(value: Column) -> Column:
    """Bytes of base64 text, with or without a data-URL prefix before a comma."""
    return F.unbase64(F.element_at(F.split(value, ","), -1))
