"""Folders of captions and images as DataFrames."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import text
from ..operators.masks import dealt


#: Names, and bytes of contents at least, of which a batch is made.
NAMES_AT_ONCE, BYTES_AT_ONCE = 10_000, 4 << 20


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file of this name."""
    return (name[0] in "_." and not (name[0] == "_" and "=" in name) or name.endswith("._COPYING_")) and not name.startswith(("_metadata", "_common_metadata"))


def names(spark: SparkSession, folder: str) -> DataFrame:
    """(path, file, length) of the files directly in a folder, empty ones too, without those that Spark's readers hide.

    A task lists the folder, whose names are then dealt over all tasks: the driver, which Spark's readers make hold
    an index of the folder and a task of each few files, holds no name.
    """
    root = folder.rstrip("/")
    system, path = fs.FileSystem.from_uri(root)
    if system.get_file_info(path).type != fs.FileType.Directory:
        raise FileNotFoundError(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            system, path = fs.FileSystem.from_uri(root)
            infos = system.get_file_info(fs.FileSelector(path)) if batch.num_rows else []
            for at in range(0, len(infos), NAMES_AT_ONCE):
                own = [(f.base_name, f.size) for f in infos[at : at + NAMES_AT_ONCE] if f.type == fs.FileType.File and not _hidden(f.base_name)]
                yield pa.RecordBatch.from_pydict({"file": pa.array([n for n, _ in own], pa.string()), "length": pa.array([s for _, s in own], pa.int64())})

    found = dealt(spark.range(0, 1, 1, 1).mapInArrow(run, "file string, length long"), "file")
    return found.select(F.concat(F.lit(f"{root}/"), "file").alias("path"), "file", "length")


def contents(listed: DataFrame, folder: str) -> DataFrame:
    """(file, length, content) of a folder's ``names``, read by the tasks that hold them."""
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(root)
        for batch in batches:
            held, size, at = [], 0, 0
            for k, (name, length) in enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True), 1):
                held.append(read_file(system, f"{path}/{name}") if length else b"")
                size += len(held[-1])
                if size >= BYTES_AT_ONCE or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(at, k - at).columns, pa.array(held, pa.binary())], ["file", "length", "content"])
                    held, size, at = [], 0, k

    return listed.select("file", "length").mapInArrow(run, "file string, length long, content binary")


def read_file(system: fs.FileSystem, path: str) -> bytes:
    with system.open_input_stream(path, compression=None) as file:
        return file.read()


def listing(spark: SparkSession, folder: str, extensions: Sequence[str]) -> DataFrame:
    """(path, file, stem, ext, length) of files with one of the extensions, whatever their case; contents stay unread."""
    files = names(spark, folder)
    named = files.withColumns({"stem": text.stem(F.col("file")), "ext": F.lower(text.extension(F.col("file")))})
    return named.where(F.col("ext").isin(*extensions)).select("path", "file", "stem", "ext", "length")


def images(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder, vocab.IMAGE_EXTENSIONS)


def captions(spark: SparkSession, folder: str, lenient: bool = True) -> DataFrame:
    """(file, stem, text, error) of the .txt files. Text that is not UTF-8 is '' if lenient, else null with an error."""
    named = contents(listing(spark, folder, [".txt"]), folder).withColumn("stem", text.stem(F.col("file")))
    decoded = F.try_validate_utf8(F.col("content").cast("string"))
    body = F.coalesce(decoded, F.lit("")) if lenient else decoded
    return named.select("file", "stem", body.alias("text"), F.when(decoded.isNull(), "not UTF-8").alias("error"))


def mixed(folder: DataFrame | None, uploads: DataFrame | None) -> DataFrame:
    """(file, path) of a folder's images, then of uploads; uploads of an unsupported kind keep a null path."""
    sides = []
    if folder is not None:
        sides.append(folder.select("file", "path"))
    if uploads is not None:
        good = F.lower(text.extension(F.col("file"))).isin(*vocab.IMAGE_EXTENSIONS)
        sides.append(uploads.select("file", F.when(good, F.col("path")).alias("path")))
    if not sides:
        raise ValueError("neither a folder nor uploads")
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height from the header of a PNG, GIF, BMP, WebP or JPEG file; ValueError if it is none."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if kind == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                raise ValueError("broken JPEG marker")
            mark = data[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 if mark == 0xFF or 0xD0 <= mark <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    raise ValueError("not a supported image")


#: Longest error message that is kept.
ERROR_CHARS = 80


def with_size(files: DataFrame) -> DataFrame:
    """(image, width, height, error) of (file, content); width and height are null where the header can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, data in zip(batch["file"], batch["content"], strict=True):
                try:
                    rows.append((name, *image_size(bytes(data)), None))
                except (ValueError, TypeError, struct.error) as e:
                    rows.append((name, None, None, str(e)[:ERROR_CHARS]))
            yield pd.DataFrame(rows, columns=["image", "width", "height", "error"]).astype({"width": "Int64", "height": "Int64"})

    return files.select("file", "content").mapInPandas(run, "image string, width bigint, height bigint, error string")


def image_contents(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of a folder's images."""
    return contents(images(spark, folder), folder).select("file", "content")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(tag, alias) of a CSV file with a header: first alias of the last row of each tag."""
    from ..operators import tags

    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').schema("tag string, alias string").csv(path)
    return tags.alias_dictionary(rows.withColumn("at", F.monotonically_increasing_id()), "at")


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, tag, category) of a vocabulary in JSON: two maps, a map of records, or two maps under dataset_info.tag_mapping.

    Categories are lower-cased; a tag without one is general. Any other layout is a ValueError.
    """
    raw = spark.read.option("wholetext", "true").text(path)
    two = "struct<idx_to_tag:map<string,string>,tag_to_category:map<string,string>>"
    shape = f"struct<dataset_info:struct<tag_mapping:{two}>,{two[7:-1]}>"
    row = raw.select(F.from_json("value", shape).alias("v"), "value")
    found = row.select(F.coalesce("v.dataset_info.tag_mapping", F.struct("v.idx_to_tag", "v.tag_to_category")).alias("m"), "value")
    kind = found.select(F.col("m.idx_to_tag").isNotNull()).first()
    if kind and kind[0]:
        pairs = found.select("m.tag_to_category", F.explode("m.idx_to_tag").alias("idx", "tag"))
        category = F.lower(F.coalesce(F.try_element_at("tag_to_category", "tag"), F.lit("general")))
        return pairs.select(F.col("idx").cast("int").alias("idx"), "tag", category.alias("category"))
    records = found.select(F.explode(F.from_json("value", "map<string,struct<tag:string,category:string>>")).alias("idx", "r"))
    rows = records.where("r.tag IS NOT NULL").select(
        F.col("idx").try_cast("int").alias("idx"), "r.tag", F.lower(F.coalesce("r.category", F.lit("general"))).alias("category")
    )
    if rows.where("idx IS NOT NULL").limit(1).count() == 0:
        raise ValueError(f"{path}: not a vocabulary")
    return rows


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """(idx, tag) of a JSON list of names."""
    raw = spark.read.option("wholetext", "true").text(path)
    return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "tag"))


ANNOTATION = (
    "version string, flags map<string,boolean>, shapes array<struct<label:string,points:array<array<double>>,group_id:int,"
    "shape_type:string,flags:map<string,boolean>>>, imagePath string, imageData string, imageHeight int, imageWidth int"
)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(file, image, width, height, label, group_id, points) of polygons with 3 points or more on images of a known size."""
    rows = spark.read.schema(ANNOTATION).option("multiLine", "true").json(path)
    rows = rows.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
    sized = rows.where("imageHeight > 0 AND imageWidth > 0")
    shapes = sized.select("file", F.col("imagePath").alias("image"), F.col("imageWidth").alias("width"), F.col("imageHeight").alias("height"), F.explode("shapes").alias("s"))
    return shapes.select("file", "image", "width", "height", "s.label", "s.group_id", "s.points").where(F.size("points") >= 3)


def annotation_summary(shapes: DataFrame) -> DataFrame:
    """By file: distinct labels in order, shapes and points."""
    return shapes.groupBy("file").agg(
        F.sort_array(F.collect_set("label")).alias("labels"), F.count(F.lit(1)).alias("shapes"), F.sum(F.size("points")).alias("points")
    )


REPORT = (
    "image string, size struct<width:int,height:int>, parts map<string,struct<count:int,confidence:double,has_detection:boolean,"
    "mask_pixels:bigint,mask_ratio_percent:double,mask_file:string,error:string>>, timing map<string,double>"
)


def mask_reports(spark: SparkSession, path: str) -> DataFrame:
    """(image, width, height, part, …) of reports in JSON, one row a part."""
    rows = spark.read.schema(REPORT).option("multiLine", "true").json(path)
    long = rows.select("image", "size.width", "size.height", F.explode("parts").alias("part", "r"))
    return long.select("image", "width", "height", "part", "r.*")


def render_parts(reports: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """(image, part, mask_file) of detected parts with a file, of those wanted if any are named."""
    found = reports.where("has_detection AND mask_file IS NOT NULL")
    return (found.where(F.col("part").isin(*wanted)) if wanted else found).select("image", "part", "mask_file")


def alias_parts(requested: Sequence[str], aliases: dict[str, str]) -> list[str]:
    """Canonical names of requested parts, in order and once each."""
    return list(dict.fromkeys(aliases.get(p, p) for p in requested))
