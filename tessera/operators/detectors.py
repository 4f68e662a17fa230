"""Detectors and taggers as chains: what a model says, brought to parts and tags with counts, confidences and masks.

Masks are runs (image, y, x1, x2). The models stand behind ``inference``; here are the rules around them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from . import boxes, inference, masks, runs, scores, tags

#: Probability from which the tag engine names a tag, unless all are asked for.
NAMED = 0.35
#: Regions that count within a precise part: shares of the image and sides.
PRECISE = {"min_share": 0.000008, "max_share": 0.04, "min_side": 3}


def second_output(outputs: DataFrame) -> DataFrame:
    """(image, idx, logit) of (image, outputs): the second of a model's lists of logits, or the first if it is alone.

    Null and empty outputs have no rows.
    """
    chosen = F.coalesce(F.get("outputs", F.lit(1)), F.get("outputs", F.lit(0)))
    return outputs.select("image", F.posexplode(chosen).alias("idx", "logit"))


def engine_tags(images: DataFrame, build: Callable[[str], Callable], name: str = "engine", least: float | None = NAMED) -> DataFrame:
    """(image, tag, probability) of whole images: tags that reach ``least``, or all a model names if it is null.

    An image that the model fails on has no tags.
    """
    whole = images.select("image", F.lit(0).alias("region"), "width", "height", "raster")
    said = inference.answers(whole, build, name, "map<string, double>")
    rows = said.select("image", F.explode("answer").alias("tag", "probability"))
    return rows if least is None else rows.where(F.col("probability") >= least)


def handler_tags(rows: DataFrame, general: float, character: float, mapping: DataFrame) -> DataFrame:
    """(image, category, tag, score): scores that exceed their threshold, each as 1.0, and the sources of the characters.

    ``rows`` (image, tag, category, probability), ``mapping`` (character, ip). Sources have the category ``ip``.
    """
    kept = scores.above(rows, general, character, strict=True).select("image", "category", "tag", F.lit(1.0).alias("score"))
    own = kept.where("category = 'character'").select("image", F.col("tag").alias("character"))
    ips = tags.sources_of(own, mapping).select("image", F.lit("ip").alias("category"), F.explode("ips").alias("tag"), F.lit(1.0).alias("score"))
    return kept.unionByName(ips)


def combined_tags(images: DataFrame, looked_up: DataFrame, tagged: DataFrame) -> DataFrame:
    """(image, tags, found_by): the sorted union of the tags that a lookup and a tagger have for an image.

    ``looked_up`` (image, tags) and ``tagged`` (image, tags); ``found_by`` is both, lookup, tagger or none.
    """
    rows = images.select("image").join(looked_up.select("image", F.col("tags").alias("a")), "image", "left").join(tagged.select("image", F.col("tags").alias("b")), "image", "left")
    a, b = F.size(F.coalesce("a", F.array())) > 0, F.size(F.coalesce("b", F.array())) > 0
    by = F.when(a & b, "both").when(a, "lookup").when(b, "tagger").otherwise("none")
    return rows.select("image", tags.merged(F.col("a"), F.col("b")).alias("tags"), by.alias("found_by"))


def centre_boxes(outputs: DataFrame, least: float) -> DataFrame:
    """(image, label, bbox, score) of a letterboxed model's rows (image, width, height, scale, pad_w, pad_h, row).

    A ``row`` holds the centre, the size and one score, or a score a class, of which the best is the label, 0 for a
    single one. Rows below ``least``, shorter rows and boxes with nothing on the image go.
    """
    several = F.size("row") > 5
    given = F.slice("row", 5, F.size("row") - 4)
    score = F.array_max(given)
    rows = outputs.where(F.size("row") >= 5).withColumns({"score": score.cast("double"), "label": F.when(several, F.array_position(given, score) - 1).otherwise(0).cast("int")})
    at = lambda i: F.get("row", F.lit(i))
    box = geometry.from_centre(at(0), at(1), at(2), at(3), F.col("scale"), F.col("pad_w"), F.col("pad_h"), F.col("width"), F.col("height"), True)
    found = rows.where(F.col("score") >= least).select("image", "label", box.alias("bbox"), "score")
    return found.where("bbox.x2 > bbox.x1 AND bbox.y2 > bbox.y1")


def boxes_only(detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs that all boxes cover, none suppressed, and (image, count, confidence) of the detections (image, bbox, score)."""
    covered = runs.of_boxes(detections.select("image", "bbox.*"), ["image"])
    return covered, detections.groupBy("image").agg(F.count(F.lit(1)).alias("count"), F.avg("score").alias("confidence"))


def text_bubbles(images: DataFrame, candidates: DataFrame, build: Callable[[str], Callable], name: str = "reader", least: int = 1) -> tuple[DataFrame, DataFrame]:
    """The runs of the regions of candidate masks (mask_id = image, width, height, raster) in which a model reads text, and (image, count).

    A region is read in its box with a margin; one that the model fails on stays. Images without a kept region have
    no row.
    """
    named = masks.regions(candidates)
    box = F.struct(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("bbox")
    kept = inference.text_regions(images, named.select(F.col("mask_id").alias("image"), "region", box), build, name, least).select("image", "region")
    covered = masks.region_runs(candidates).withColumnRenamed("mask_id", "image").join(kept, ["image", "region"])
    return runs.union(covered, ["image"]), kept.groupBy("image").agg(F.count(F.lit(1)).alias("count"))


def refined_boxes(images: DataFrame, detections: DataFrame, build: Callable[[str], Callable], wanted: Sequence[str] = (), overlap: float | None = None, shrink: float | Column | None = None, fallback: bool = True, name: str = "refiner") -> tuple[DataFrame, DataFrame]:
    """The refined masks (mask_id, width, height, raster, source) of detections, and (image, count, confidence) of these.

    Detections (image, label, bbox, score) of the labels wanted; with ``overlap``, those that a better one of their label
    overlaps more go first.
    """
    own = boxes.of_classes(detections, wanted)
    own = own if overlap is None else boxes.suppress(own, overlap)
    seen = own.groupBy("image").agg(F.count(F.lit(1)).alias("count"), F.avg("score").alias("confidence"))
    point = F.lit(None).cast("struct<x: int, y: int>").alias("point")
    asked = own.withColumn("box", F.col("bbox")).select(*[c for c in own.columns if c not in ("box", "point", "positive")], "box", point, F.lit(None).cast("boolean").alias("positive"))
    return inference.refined(images, asked, build, name, shrink, fallback), seen


def segments_and_boxes(images: DataFrame, segments: DataFrame, found: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The runs that segments (image, y, x1, x2) and boxes (image, x1, y1, x2, y2) cover, and (image, count, confidence, pixels) of all images.

    The count is 1 and the confidence the threshold where anything is covered, else both are 0.
    """
    covered = runs.union(segments.select("image", "y", "x1", "x2").unionByName(runs.of_boxes(found, ["image"])), ["image"])
    area = F.coalesce("pixels", F.lit(0).cast("long"))
    seen = images.select("image").join(runs.areas(covered, ["image"]), "image", "left")
    some = area > 0
    return covered, seen.select("image", F.when(some, 1).otherwise(0).alias("count"), F.when(some, F.lit(float(threshold))).otherwise(0.0).alias("confidence"), area.alias("pixels"))


def sensitive_parts(found: DataFrame, classes: Mapping[str, Sequence[str]], steps: DataFrame) -> DataFrame:
    """(image, part, width, height, raster, count, confidence): each part's masks joined and put through its chain.

    ``found`` (image, label, confidence, width, height, raster) has a row a detection; ``classes`` names the labels of each
    part, ``steps`` is the table of ``masks.chained``. The count is the larger one of regions and detections; a part
    whose chain leaves no pixel goes.
    """
    named = F.create_map(*[x for part, labels in classes.items() for label in labels for x in (F.lit(label), F.lit(part))])
    rows = found.withColumn("part", named[F.col("label")]).where("part IS NOT NULL AND raster IS NOT NULL")
    seen = rows.groupBy("image", "part").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))
    key = F.struct("image", "part")
    joined = masks.merged_files(rows.select(key.alias("image"), F.xxhash64("raster", "confidence").alias("place"), "width", "height", "raster"))
    done = masks.chained(joined.withColumn("part", F.col("mask_id.part")), steps)
    both = _with_regions(done).join(seen, ["image", "part"]).where("regions > 0")
    return both.select("image", "part", "width", "height", "raster", F.greatest("regions", "n").alias("count"), "confidence")


def _with_regions(done: DataFrame) -> DataFrame:
    """(image, part, width, height, raster, regions) of chained masks."""
    kinds = dict(done.select("mask_id.image", "part").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in masks.sliced(batches):
            found = [len(masks.label_regions(masks.to_array(r.as_buffer(), w, h))) for w, h, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], ["image", "part", "width", "height", "raster", "regions"])

    rows = done.select(F.col("mask_id.image").alias("image"), "part", "width", "height", "raster")
    return rows.mapInArrow(run, f"image {kinds['image']}, part {kinds['part']}, width int, height int, raster binary, regions long")


def precise(rasters: DataFrame) -> DataFrame:
    """Masks (mask_id, width, height, raster) without the regions that are no precise part, before they are joined with others."""

    def keep(mask: np.ndarray) -> np.ndarray:
        least, most = max(1, int(mask.size * PRECISE["min_share"])), int(mask.size * PRECISE["max_share"])
        return masks.keep_regions(mask, least, most, PRECISE["min_side"], PRECISE["min_side"])

    return masks.per_mask(rasters, keep)


def custom(images: DataFrame, build: Callable[[str], Callable], path: str, confidence: float, wanted: Sequence[str] = ()) -> DataFrame:
    """(image, label, score, bbox) of a model file's detections that reach ``confidence``, of the labels wanted or all.

    model(pixels) gives (label, score, x1, y1, x2, y2). A worker keeps a model by its file, threshold and labels; an image
    that it fails on has no detections.
    """
    name = f"{path}|{confidence}|{','.join(wanted)}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = inference.model_of(name, lambda _: build(path))
        for b in batches:
            rows = []
            for image, w, h, raster in zip(b["image"], b["width"], b["height"], b["raster"], strict=True):
                try:
                    found = [] if model is None or raster is None else list(model(inference.pixels_of(raster, int(w), int(h))))
                except Exception:  # whatever a model raises
                    found = []
                rows += [(image, label, float(score), *map(int, box)) for label, score, *box in found]
            yield pd.DataFrame(rows, columns=["image", "label", "score", "x1", "y1", "x2", "y2"])

    kind = dict(images.dtypes)["image"]
    found = images.select("image", "width", "height", "raster").mapInPandas(run, f"image {kind}, label string, score double, x1 int, y1 int, x2 int, y2 int")
    kept = boxes.of_classes(found.where(F.col("score") >= confidence), wanted)
    return kept.select("image", "label", "score", F.struct("x1", "y1", "x2", "y2").alias("bbox"))


def saved_masks(parts: DataFrame, prefix: str = "mask", individual: bool = False, single: bool = False, invert: bool = False) -> DataFrame:
    """(image, file, width, height, raster) of persons' parts (image, person_id, gender, part, width, height, y, x1, x2) by option.

    ``individual``: a mask a part; ``single``: one of all; with neither, one a person and one of all. What covers nothing
    has no file. ``invert`` swaps covered and free pixels.
    """
    size = ["image", "width", "height"]

    def made(*name: Column) -> DataFrame:
        named = parts.select(*size, F.concat(F.concat_ws("_", F.lit(prefix), *name), F.lit(".png")).alias("file"), "y", "x1", "x2")
        covered = runs.union(named, [*size, "file"])
        key = F.struct("image", "file")
        found = runs.rasterized(covered.withColumn("key", key), "key", F.col("width"), F.col("height"))
        return found.select("mask_id.image", "mask_id.file", "width", "height", "raster")

    person = [F.col("person_id").cast("string"), F.col("gender")]
    out = []
    if individual:
        out.append(made(*person, F.col("part")))
    if single:
        out.append(made(F.lit("mask")))
    elif not individual:
        out += [made(*person, F.lit("merged")), made(F.lit("all_merged"))]
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    if not invert:
        return rows
    swapped = masks.inverted(rows.withColumn("mask_id", F.struct("image", "file")))
    return swapped.select("mask_id.image", "mask_id.file", "width", "height", "raster")
