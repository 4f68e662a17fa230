"""Model chains around the inference boundary: prompts, crops, scales, heatmaps and prepared inputs.

A model is a function that ``build(name)`` returns; each worker builds it once by its name. Images are rows
(image, width, height, raster) of three bytes a pixel (RGB) or one (grey). What a model says of an
image becomes rows, and its failure a value, never a failed job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..sources.pictures import on_white
from . import boxes, masks, runs

#: Longer sides that multi-scale detection tries, and how many times an image's own it goes up to.
SCALES, MOST_GROWTH = (640, 1024, 1280), 2
#: Margin around a text region: a share of its shorter side, and pixels at least.
TEXT_MARGIN, LEAST_MARGIN = 0.05, 2
#: Sides of a person's crop below which no model is asked, and the answer then.
LEAST_SIDE, DEFAULT_GENDER, DEFAULT_SURE = 20, "female", 0.5
#: Keypoints of a whole pose.
POINTS = 17

_MODELS: dict[str, Callable | None] = {}


def model_of(name: str, build: Callable[[str], Callable]) -> Callable | None:
    """A worker's model of that name; one that cannot be built is None and not tried again."""
    if name not in _MODELS:
        try:
            _MODELS[name] = build(name)
        except Exception:  # whatever a model's loader raises
            _MODELS[name] = None
    return _MODELS[name]


def pixels_of(raster: bytes, width: int, height: int) -> np.ndarray:
    """(height, width) or (height, width, 3)."""
    values = np.frombuffer(raster, np.uint8)
    return values.reshape((height, width) if len(values) == width * height else (height, width, 3))


def _asked(model: Callable | None, *of) -> list[np.ndarray] | None:
    """The model's masks, None if it is not there or fails."""
    try:
        return None if model is None else list(model(*of))
    except Exception:  # whatever a model raises
        return None


def refined(images: DataFrame, prompts: DataFrame, build: Callable[[str], Callable], name: str = "refiner", shrink: float | Column | None = None, fallback: bool = True) -> DataFrame:
    """(mask_id, width, height, raster, source): one mask an image from its prompts (image, box, point, positive).

    ``box`` (x1, y1, x2, y2) or ``point`` (x, y) is null; points without ``positive`` are. The model is asked
    model(pixels, boxes, [], []) and model(pixels, [], points, labels) and answers with masks of any size;
    all are joined. Where boxes got no pixel or the model failed, the boxes themselves stand, shrunk
    towards their centres by ``shrink`` (a number or a column of ``prompts``), unless ``fallback`` is off. ``source`` says model, boxes or
    none. Empty boxes ask for nothing; images without prompts and prompts without an image have no row.
    """
    box, point = F.col("box"), F.col("point")
    small = box if shrink is None else geometry.shrink(box, shrink)
    edges = [b[c].cast("int").alias(f"{n}_{c}") for b, n in ((box, "b"), (small, "s")) for c in ("x1", "y1", "x2", "y2")]
    spots = [point["x"].cast("double").alias("x"), point["y"].cast("double").alias("y"), F.coalesce("positive", F.lit(True)).cast("int").alias("label")]
    asked = prompts.select("image", *edges, *spots)

    def run(image: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if image.empty or own.empty or image["raster"].iloc[0] is None:
            return pd.DataFrame(columns=["mask_id", "width", "height", "raster", "source"])
        w, h = int(image["width"].iloc[0]), int(image["height"].iloc[0])
        view, model = pixels_of(image["raster"].iloc[0], w, h), model_of(name, build)
        mask, source = np.zeros((h, w), np.uint8), "none"
        boxed = own[(own["b_x2"] > own["b_x1"]) & (own["b_y2"] > own["b_y1"])].sort_values(["b_x1", "b_y1", "b_x2", "b_y2"])
        if len(boxed):
            answers = _asked(model, view, boxed[["b_x1", "b_y1", "b_x2", "b_y2"]].astype(int).to_numpy().tolist(), [], [])
            for a in answers or []:
                mask = np.maximum(mask, masks.from_probabilities(np.asarray(a, float), w, h))
            if mask.any():
                source = "model"
            elif fallback:
                source = "boxes"
                for x1, y1, x2, y2 in boxed[["s_x1", "s_y1", "s_x2", "s_y2"]].astype(int).to_numpy().tolist():
                    mask[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)] = 255
        dots = own[own["x"].notna() & own["y"].notna()].sort_values(["x", "y", "label"])
        if len(dots):
            for a in _asked(model, view, [], dots[["x", "y"]].to_numpy().tolist(), dots["label"].astype(int).tolist()) or []:
                mask, source = np.maximum(mask, masks.from_probabilities(np.asarray(a, float), w, h)), "model"
        return pd.DataFrame({"mask_id": image["image"].iloc[:1], "width": [w], "height": [h], "raster": [mask.tobytes()], "source": [source]})

    kind = dict(images.dtypes)["image"]
    rows = images.select("image", "width", "height", "raster")
    return rows.groupBy("image").cogroup(asked.groupBy("image")).applyInPandas(run, f"mask_id {kind}, width int, height int, raster binary, source string")


def margin(box: Column, share: float = TEXT_MARGIN, least: int = LEAST_MARGIN) -> Column:
    """A box with a margin of a share of its shorter side, in whole pixels."""
    side = F.least(box["x2"] - box["x1"], box["y2"] - box["y1"])
    by = F.greatest(F.lit(least), F.floor(side * share)).cast("int")
    return geometry.box(box["x1"] - by, box["y1"] - by, box["x2"] + by, box["y2"] + by)


def crops(images: DataFrame, regions: DataFrame) -> DataFrame:
    """(image, region, width, height, raster): each region (image, region, bbox) cut from its image as a row of its own.

    What lies outside the image is cut off; nothing left has a null raster. An image's regions, tens at
    most, travel with its raster, so that a raster is shuffled once. Regions without an image have no row.
    """
    corners = [F.col("bbox")[c].cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")]
    folded = regions.groupBy("image").agg(F.collect_list(F.struct("region", *corners)).alias("regions"))
    rows = images.where("raster IS NOT NULL").select("image", "width", "height", "raster").join(folded, "image")
    kinds = dict(images.dtypes) | dict(regions.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in masks.sliced(batches):
            for k, (w, h, raster, own) in enumerate(zip(*[batch.column(j).to_pylist() for j in (1, 2, 3, 4)], strict=True)):
                view, out = pixels_of(raster, w, h), []
                for r in own:
                    x1, y1, x2, y2 = max(0, r["x1"]), max(0, r["y1"]), min(w, r["x2"]), min(h, r["y2"])
                    cut = view[y1:y2, x1:x2] if x2 > x1 and y2 > y1 else None
                    out.append((None, None, None) if cut is None else (x2 - x1, y2 - y1, cut.tobytes()))
                width, height, cuts = zip(*out, strict=True)
                owner = batch.column(0).take(pa.array([k] * len(own)))
                region = batch.column(4).slice(k, 1).flatten().field("region")
                yield pa.RecordBatch.from_arrays([owner, region, pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(cuts, pa.binary())], ["image", "region", "width", "height", "raster"])

    return rows.mapInArrow(run, f"image {kinds['image']}, region {kinds['region']}, width int, height int, raster binary")


def answers(cut: DataFrame, build: Callable[[str], Callable], name: str, schema: str) -> DataFrame:
    """(image, region, answer, state) of crops: model(list of pixels) gives a value of ``schema`` for each.

    ``state`` is asked, empty (a null raster), failed or absent (no such model). A batch that fails is asked one
    by one, so that only what fails alone is lost.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(name, build)
        pieces = (whole.iloc[at : at + masks.MASKS_AT_ONCE].reset_index(drop=True) for whole in batches for at in range(0, len(whole), masks.MASKS_AT_ONCE))
        for b in pieces:
            views = [None if r is None else pixels_of(r, int(w), int(h)) for r, w, h in zip(b["raster"], b["width"], b["height"], strict=True)]
            at = [k for k, v in enumerate(views) if v is not None]
            found: list = [None] * len(views)
            state = ["empty" if v is None else "asked" if model else "absent" for v in views]
            if model and at:
                try:
                    for k, value in zip(at, model([views[k] for k in at]), strict=True):
                        found[k] = value
                except Exception:  # whatever a model raises
                    for k in at:
                        try:
                            found[k] = list(model([views[k]]))[0]
                        except Exception:
                            found[k], state[k] = None, "failed"
            yield pd.DataFrame({"image": b["image"], "region": b["region"], "answer": pd.Series(found, dtype=object), "state": state})

    kinds = dict(cut.dtypes)
    return cut.mapInPandas(run, f"image {kinds['image']}, region {kinds['region']}, answer {schema}, state string")


def text_regions(images: DataFrame, regions: DataFrame, build: Callable[[str], Callable], name: str = "reader", least: int = 1) -> DataFrame:
    """(image, region, text) of the regions (image, region, bbox) in whose crop, with a margin, a model reads text.

    A region stays with an empty text where the model failed or is absent; one outside its image goes.
    """
    cut = crops(images, regions.withColumn("bbox", margin(F.col("bbox"))))
    read = answers(cut, build, name, "string").where("state <> 'empty'")
    sure = read.withColumn("text", F.when(F.col("state") == "asked", F.trim(F.coalesce("answer", F.lit("")))))
    return boxes.with_text(sure, least).select("image", "region", F.coalesce("text", F.lit("")).alias("text"))


def genders(images: DataFrame, people: DataFrame, build: Callable[[str], Callable], girl: Sequence[str], boy: Sequence[str], name: str = "tagger", least: float = 0.5) -> DataFrame:
    """(image, person_id, gender, confidence) of people (image, person_id, bbox): the rule of ``boxes.gender`` on the tags of their crops.

    The model gives a crop's tags as a map to probabilities. Crops below LEAST_SIDE, failures and an absent
    model have the default.
    """
    cut = crops(images, people.select("image", F.col("person_id").alias("region"), "bbox"))
    wide = (F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE)
    said = answers(cut.withColumn("raster", F.when(wide, F.col("raster"))), build, name, "map<string, double>")
    key = F.struct("image", "region")
    known = said.where("state = 'asked'").select(key.alias("key"), F.explode_outer("answer").alias("tag", "probability"))
    found = boxes.gender(known, girl, boy, least).select("key.image", F.col("key.region").alias("person_id"), "gender", "confidence")
    other = said.where("state <> 'asked'").select("image", F.col("region").alias("person_id"), F.lit(DEFAULT_GENDER).alias("gender"), F.lit(DEFAULT_SURE).alias("confidence"))
    return found.unionByName(other)


def scaled(images: DataFrame, scales: Sequence[int] = SCALES) -> DataFrame:
    """A row for each scale (longer side) of an image that is not beyond MOST_GROWTH times its own."""
    longer = F.greatest("width", "height")
    fits = F.filter(F.array(*map(F.lit, scales)), lambda s: s <= longer * MOST_GROWTH)
    return images.select("*", F.explode(fits).alias("scale"))


def detections(images: DataFrame, build: Callable[[str], Callable], name: str = "segmenter", scales: Sequence[int] = SCALES) -> DataFrame:
    """(image, width, height, scale, place, label, confidence, raster) of what a model sees at each scale, masks at the image's size.

    The model is asked model(pixels at the scale, scale) and gives (label, confidence, mask of any size); one
    that fails at a scale sees nothing there.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(name, build)
        for b in batches:
            rows = []
            for image, w, h, raster, scale in zip(b["image"], b["width"], b["height"], b["raster"], b["scale"], strict=True):
                view = pixels_of(raster, w, h)
                to = [max(1, round(side * scale / max(w, h))) for side in (w, h)]
                planes = [view] if view.ndim == 2 else list(np.moveaxis(view, 2, 0))
                small = np.stack([np.rint(masks.resize(p, *to)).astype(np.uint8) for p in planes], 2)
                for k, (label, sure, mask) in enumerate(_asked(model, small[..., 0] if len(planes) == 1 else small, int(scale)) or []):
                    rows.append((image, w, h, scale, k, label, float(sure), masks.from_probabilities(np.asarray(mask, float), w, h).tobytes()))
            yield pd.DataFrame(rows, columns=["image", "width", "height", "scale", "place", "label", "confidence", "raster"])

    rows = scaled(images.where("raster IS NOT NULL").select("image", "width", "height", "raster"), scales)
    kind = dict(images.dtypes)["image"]
    return rows.mapInPandas(run, f"image {kind}, width int, height int, scale int, place int, label string, confidence double, raster binary")


def over_scales(found: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The runs (image, y, x1, x2) of all masks of the labels wanted, and (image, count, confidence): detections and their mean."""
    own = boxes.of_classes(found, wanted)
    seen = own.groupBy("image").agg(F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("confidence"))
    covered = runs.of_rasters(own.withColumnRenamed("image", "mask_id")).withColumnRenamed("mask_id", "image")
    return runs.union(covered, ["image"]), seen


def keypoints(heatmaps: DataFrame) -> DataFrame:
    """(image, width, height, person, idx, x, y, conf) of heatmaps (image, width, height, person, bbox, rows, columns, values).

    ``values`` holds POINTS maps of rows x columns, one after the other; of each the first place of its largest
    value is brought from the crop ``bbox`` to the image. Fewer maps or an empty crop give nothing.
    """
    size, b = F.col("rows") * F.col("columns"), F.col("bbox")
    whole = heatmaps.where((F.size("values") >= size * POINTS) & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]) & (size > 0))
    one = whole.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(POINTS - 1)))).withColumn("map", F.slice("values", F.col("idx") * size + 1, size))
    at = F.array_position("map", F.array_max("map")) - 1
    x = b["x1"] + F.pmod(at, F.col("columns")) / F.col("columns") * (b["x2"] - b["x1"])
    y = b["y1"] + F.floor(at / F.col("columns")) / F.col("rows") * (b["y2"] - b["y1"])
    return one.select("image", "width", "height", "person", "idx", x.cast("int").alias("x"), y.cast("int").alias("y"), F.array_max("map").cast("double").alias("conf"))


@cache
def bicubic(size: int, to: int) -> np.ndarray:
    """(to, size): weights of cubic resampling; a smaller size takes in as many more pixels."""
    scale = size / to
    wide = max(scale, 1.0)
    far = np.abs((np.arange(size)[None, :] + 0.5) - (np.arange(to)[:, None] + 0.5) * scale) / wide
    near = (1.5 * far - 2.5) * far**2 + 1
    rest = ((-0.5 * far + 2.5) * far - 4) * far + 2
    weights = np.where(far < 1, near, np.where(far < 2, rest, 0.0))
    return weights / weights.sum(1, keepdims=True)


def prepared(view: np.ndarray, size: int, mean: float = 0.5, deviation: float = 0.5) -> np.ndarray:
    """(3, size, size): a picture centred on a white square, resampled, blue first, shares of 255 normalised."""
    view = on_white(view)
    h, w = view.shape[:2]
    side = max(h, w)
    square = np.full((side, side, 3), 255, np.uint8)
    square[(side - h) // 2 : (side - h) // 2 + h, (side - w) // 2 : (side - w) // 2 + w] = view
    weights = bicubic(side, size)
    planes = np.moveaxis(square, 2, 0)[::-1].astype(float)
    step = lambda v: np.floor(v + 0.5).clip(0, 255)  # noqa: E731  whole values between the two passes
    planes = step(weights @ step(planes @ weights.T)) if side != size else planes
    return ((planes / 255 - mean) / deviation).astype(np.float32)


def model_inputs(images: DataFrame, size: int, mean: float = 0.5, deviation: float = 0.5) -> DataFrame:
    """(image, input): ``prepared`` of each image as one array of 3 * size * size floats by channels; null rasters stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row a batch: an input is some megabytes
                _, w, h, raster = [c[k] for c in batch.columns]
                made = prepared(pixels_of(raster.as_buffer(), w.as_py(), h.as_py()), size, mean, deviation).ravel() if raster.is_valid else None
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([made], pa.list_(pa.float32()))], ["image", "input"])

    kind = dict(images.dtypes)["image"]
    return images.select("image", "width", "height", "raster").mapInArrow(run, f"image {kind}, input array<float>")
