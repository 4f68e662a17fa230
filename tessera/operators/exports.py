"""Exports of a folder into several others: what is there already stays, and a manifest says what was done.

Each file is written under another name first and compared before, so a run that was stopped goes on where it
was, and a repeated one changes nothing. Sources change only by a plan that names what it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import captions as caption_rules
from ..sources import files
from . import pairing

_MANIFEST = "target string, file string, bytes long, md5 string, state string"


def split_plan(spark: SparkSession, folder: str) -> DataFrame:
    """(target, file, content, source) of a folder's captions split: texts of tags and captions, and the path of each one's image.

    Targets are ``tag`` and ``caption``. A side that is empty for a caption has no file there, neither text nor image.
    """
    root = folder.rstrip("/")
    texts = files.captions(spark, root).select("file", "stem", caption_rules.split_caption(F.col("text")).alias("s"))
    images = pairing.one_image(files.images(spark, root)).select("stem", "image")
    both = texts.join(images, "stem", "left")
    out = None
    for target, column in (("tag", "s.tags_text"), ("caption", "s.caption_text")):
        own = both.where(F.trim(F.col(column)) != "")
        text = own.select(F.lit(target).alias("target"), "file", F.encode(F.trim(F.col(column)), "UTF-8").alias("content"), F.lit(None).cast("string").alias("source"))
        image = own.where("image IS NOT NULL").select(F.lit(target).alias("target"), F.col("image").alias("file"), F.lit(None).cast("binary").alias("content"), F.concat(F.lit(f"{root}/"), "image").alias("source"))
        out = text.unionByName(image) if out is None else out.unionByName(text).unionByName(image)
    return out


def _read(uri: str) -> bytes:
    system, path = fs.FileSystem.from_uri(uri.rsplit("/", 1)[0])
    with system.open_input_stream(f"{path}/{uri.rsplit('/', 1)[1]}") as file:
        return file.read()


def _put(system: fs.FileSystem, path: str, body: bytes) -> str:
    """Writes a file unless it is there with the same bytes."""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File and info.size == len(body):
        with system.open_input_stream(path) as there:
            if there.read() == body:
                return "kept"
    with system.open_output_stream(f"{path}.part") as out:
        out.write(body)
    system.move(f"{path}.part", path)
    return "written"


def carry_out(spark: SparkSession, plan: DataFrame, folders: Mapping[str, str], manifest: str) -> DataFrame:
    """Writes a plan's files into the folders of their targets; returns the manifest, which is saved as Parquet.

    (target, file, bytes, md5, state): state is written or kept. The manifest replaces an older one only when
    all files are there. Texts travel in the plan's rows, other files are copied by the tasks.
    """
    for folder in folders.values():
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
    roots = dict(folders)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_ = {t: fs.FileSystem.from_uri(f) for t, f in roots.items()}
        for b in batches:
            rows = []
            for target, file, content, source in zip(b["target"], b["file"], b["content"], b["source"], strict=True):
                body = bytes(content) if content is not None else _read(source)
                system, path = open_[target]
                rows.append((target, file, len(body), hashlib.md5(body).hexdigest(), _put(system, f"{path}/{file}", body)))
            yield pd.DataFrame(rows, columns=["target", "file", "bytes", "md5", "state"])

    done = plan.select("target", "file", "content", "source").mapInPandas(run, _MANIFEST)
    done.write.mode("overwrite").parquet(manifest)
    return spark.read.schema(_MANIFEST).parquet(manifest)


def rewrites(spark: SparkSession, folder: str) -> DataFrame:
    """(file, old_md5, text): a plan, to be reviewed, of captions that become their tags; those that are so already are left out."""
    texts = files.captions(spark, folder, lenient=False).where("text IS NOT NULL")
    tags = F.trim(caption_rules.split_caption(F.col("text"))["tags_text"])
    rows = texts.select("file", F.md5(F.encode("text", "UTF-8")).alias("old_md5"), tags.alias("new"), "text")
    return rows.where((F.col("new") != "") & (F.col("new") != F.col("text"))).select("file", "old_md5", F.col("new").alias("text"))


def rewrite(plan: DataFrame, folder: str) -> DataFrame:
    """(file, state) after a reviewed plan of ``rewrites`` was carried out, which each action on it does.

    State is rewritten, kept (the new text is there already) or changed: a file that is no longer the one that
    was reviewed is not touched.
    """
    root = folder.rstrip("/")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = fs.FileSystem.from_uri(root)
        for b in batches:
            rows = []
            for file, old, text in zip(b["file"], b["old_md5"], b["text"], strict=True):
                body, now = text.encode(), _read(f"{root}/{file}")
                state = "kept" if now == body else "changed" if hashlib.md5(now).hexdigest() != old else "rewritten"
                if state == "rewritten":
                    _put(system, f"{path}/{file}", body)
                rows.append((file, state))
            yield pd.DataFrame(rows, columns=["file", "state"])

    return plan.select("file", "old_md5", "text").mapInPandas(run, "file string, state string")


def differing(spark: SparkSession, manifest: str, folders: Mapping[str, str]) -> DataFrame:
    """(target, file, state) of a manifest's files that are missing or changed in their folders."""
    named = spark.read.schema(_MANIFEST).parquet(manifest)
    roots = dict(folders)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for target, file, md5 in zip(b["target"], b["file"], b["md5"], strict=True):
                try:
                    same = hashlib.md5(_read(f"{roots[target].rstrip('/')}/{file}")).hexdigest() == md5
                    state = None if same else "changed"
                except FileNotFoundError:
                    state = "missing"
                if state:
                    rows.append((target, file, state))
            yield pd.DataFrame(rows, columns=["target", "file", "state"])

    return named.select("target", "file", "md5").mapInPandas(run, "target string, file string, state string")
