"""Chains around models: failing models, missing outputs, options of saved masks."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tessera.operators import detectors, masks, runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import the tests
IMAGE = "image string, width int, height int, raster binary"


def images(spark, *fills):
    return spark.createDataFrame([(k, 6, 4, bytearray([v] * 24)) for k, v in zip("abcdef", fills, strict=False)] + [("n", None, None, None)], IMAGE)


def test_outputs(spark):
    rows = [("a", [[1.0], [2.0, 3.0]]), ("b", [[4.0]]), ("c", []), ("d", None), ("e", [[5.0], None])]
    got = sorted(tuple(r) for r in detectors.second_output(spark.createDataFrame(rows, "image string, outputs array<array<double>>")).collect())
    assert got == [("a", 0, 2.0), ("a", 1, 3.0), ("b", 0, 4.0), ("e", 0, 5.0)]


def test_engine_and_combined_tags(spark):
    def engine(name):
        def tags(views):
            if any(v[0, 0] == 9 for v in views):
                raise RuntimeError
            return [{"x": 0.35, "y": 0.2} for _ in views]

        return tags

    all_ = images(spark, 1, 9)
    assert sorted((r.image, r.tag) for r in detectors.engine_tags(all_, engine, "e1").collect()) == [("a", "x")]
    assert sorted((r.image, r.tag) for r in detectors.engine_tags(all_, engine, "e1", None).collect()) == [("a", "x"), ("a", "y")]
    tags = spark.createDataFrame([("a", ["x", "b"]), ("b", [])], "image string, tags array<string>")
    found = spark.createDataFrame([("a", ["x", "c"]), ("n", ["q"])], "image string, tags array<string>")
    got = {r.image: (r.tags, r.found_by) for r in detectors.combined_tags(all_, found, tags).collect()}
    assert got == {"a": (["b", "c", "x"], "both"), "b": ([], "none"), "n": (["q"], "lookup")}


def test_segments_and_boxes(spark):
    segments = spark.createDataFrame([("a", 0, 0, 3)], "image string, y int, x1 int, x2 int")
    found = spark.createDataFrame([("a", 1, 0, 4, 2), ("b", 2, 2, 2, 5)], "image string, x1 int, y1 int, x2 int, y2 int")
    covered, seen = detectors.segments_and_boxes(images(spark, 1, 2), segments, found, 0.25)
    assert {r.image: (r["count"], r.confidence, r.pixels) for r in seen.collect()} == {"a": (1, 0.25, 7), "b": (0, 0.0, 0), "n": (0, 0.0, 0)}
    assert covered.count() == 2


def test_custom_models_are_kept_apart_by_their_settings(spark):
    def build(path):
        if path == "gone":
            raise OSError

        def find(view):
            if view[0, 0] == 9:
                raise RuntimeError
            return [("cat", 0.5, 0, 0, 2, 2), ("dog", 0.9, 1, 1, 3, 3)]

        return find

    all_ = images(spark, 1, 9)
    of = lambda *a: sorted((r.image, r.label, r.bbox.x2) for r in detectors.custom(all_, build, *a).collect())
    assert of("m", 0.5) == [("a", "cat", 2), ("a", "dog", 3)] and of("m", 0.6) == [("a", "dog", 3)] and of("m", 0.5, ["cat"]) == [("a", "cat", 2)] and of("gone", 0.1) == []


def test_sensitive_parts_and_precise_regions(spark):
    square = np.zeros((20, 20), np.uint8)
    square[2:6, 2:6] = 255
    dot = np.zeros((20, 20), np.uint8)
    dot[10, 10] = 255
    rows = [("a", "l1", 0.5, square), ("a", "l1", 0.7, dot), ("a", "l2", 0.9, dot), ("a", "l9", 1.0, square)]
    found = spark.createDataFrame([(i, n, c, 20, 20, bytearray(v.tobytes())) for i, n, c, v in rows], "image string, label string, confidence double, width int, height int, raster binary")
    steps = spark.createDataFrame([("two", 0.01)], "part string, min_share double").select("part", *[F.col("min_share") if c == "min_share" else F.lit(None).alias(c) for c in masks.STEPS])
    got = {r.part: (r["count"], round(r.confidence, 3), r.raster.count(b"\xff")) for r in detectors.sensitive_parts(found, {"one": ["l1"], "two": ["l2"]}, steps).collect()}
    assert got == {"one": (2, 0.6, 17)}  # two's only region is too small
    wide = np.zeros((20, 20), np.uint8)
    wide[0:3, 0:3], wide[10, 0:9], wide[12:19, 0:9] = 255, 255, 255
    kept = detectors.precise(spark.createDataFrame([("m", 20, 20, bytearray(wide.tobytes()))], "mask_id string, width int, height int, raster binary")).first()
    assert kept.raster.count(b"\xff") == 9


def test_saved_masks(spark):
    size = F.lit(6).alias("width"), F.lit(4).alias("height")
    rows = [("a", 0, "male", "hand", 0, 0, 2), ("a", 0, "male", "face", 0, 1, 3), ("a", 1, "female", "hand", 3, 5, 9)]
    parts = spark.createDataFrame(rows, "image string, person_id int, gender string, part string, y int, x1 int, x2 int").select("*", *size)
    of = lambda **o: {r.file: r.raster.count(b"\xff") for r in detectors.saved_masks(parts, **o).collect()}
    assert of() == {"mask_0_male_merged.png": 3, "mask_1_female_merged.png": 1, "mask_all_merged.png": 4}
    assert of(individual=True) == {"mask_0_male_hand.png": 2, "mask_0_male_face.png": 2, "mask_1_female_hand.png": 1}
    assert of(single=True, prefix="p", invert=True) == {"p_mask.png": 20}
    assert set(of(individual=True, single=True)) == {"mask_0_male_hand.png", "mask_0_male_face.png", "mask_1_female_hand.png", "mask_mask.png"}
    assert detectors.saved_masks(parts.limit(0)).count() == 0


def test_refined_boxes(spark):
    box = "struct<x1: int, y1: int, x2: int, y2: int>"
    found = spark.createDataFrame([("a", "x", (0, 0, 4, 4), 0.9), ("a", "x", (0, 0, 4, 3), 0.5), ("a", "y", (0, 0, 1, 1), 0.4), ("b", "z", (0, 0, 2, 2), 0.4)], f"image string, label string, bbox {box}, score double")
    model = lambda name: lambda view, boxes, points, labels: 1 / 0
    made, seen = detectors.refined_boxes(images(spark, 1, 2), found, model, ["x", "y"], overlap=0.5, name="zero")
    assert {r.image: (r["count"], round(r.confidence, 3)) for r in seen.collect()} == {"a": (2, 0.65)}
    assert [(r.mask_id, r.source, r.raster.count(b"\xff")) for r in made.collect()] == [("a", "boxes", 16)]
    ratio = found.withColumn("ratio", F.when(F.col("label") == "x", 0.5))
    made, _ = detectors.refined_boxes(images(spark, 1, 2), ratio, model, ["x"], overlap=0.5, shrink=F.col("ratio"), name="zero")
    assert [r.raster.count(b"\xff") for r in made.collect()] == [4]
    with pytest.raises(ZeroDivisionError):
        model("x")(0, 0, 0, 0)
    assert runs.of_rasters(made).count() == 2


def test_parts_of_large_batches(spark):
    n = masks.MASKS_AT_ONCE + 3
    raster = F.unhex(F.concat(F.lit("FF00"), F.when(F.col("id") % 2 == 0, "FF").otherwise("00")))
    made = spark.range(0, n, 1, 1).select(F.struct(F.col("id").alias("image"), F.lit("p").alias("part")).alias("mask_id"), F.lit("p").alias("part"), F.lit(3).alias("width"), F.lit(1).alias("height"), raster.alias("raster"))
    assert {r.image: r.regions for r in detectors._with_regions(made).collect()} == {k: 2 - k % 2 for k in range(n)}
