"""Masks as runs against arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import masks, runs


def arrays(n, seed):
    rng = np.random.default_rng(seed)
    return {f"m{k}": np.where(rng.random((7, 12)) < rng.random(), 255, 0).astype(np.uint8) for k in range(n)}


def frame(spark, made):
    return spark.createDataFrame([(k, v.shape[1], v.shape[0], bytearray(v.tobytes())) for k, v in made.items()] + [("none", None, None, None)], "mask_id string, width int, height int, raster binary")


def back(found, key="mask_id"):
    out = {}
    for r in runs.rasterized(found, key, F.lit(12), F.lit(7)).collect():
        out[r.mask_id] = np.frombuffer(r.raster, np.uint8).reshape(7, 12)
    return out


def test_rasters_and_runs(spark):
    made = arrays(9, 1) | {"full": np.full((7, 12), 255, np.uint8), "empty": np.zeros((7, 12), np.uint8)}
    found = runs.of_rasters(frame(spark, made))
    got = back(found)
    assert set(got) == set(made) - {"empty"} and all(np.array_equal(got[k], made[k]) for k in got)
    assert {r.mask_id: r.pixels for r in runs.areas(found, ["mask_id"]).collect()} == {k: int((v > 0).sum()) for k, v in made.items() if v.any()}
    assert found.where("mask_id = 'full'").count() == 7


def test_set_operations(spark):
    a, b = arrays(6, 2), arrays(6, 3)
    one, two = (runs.of_rasters(frame(spark, x)) for x in (a, b))
    for got, want in (
        (runs.combine(one, two, "union", ["mask_id"]), np.maximum),
        (runs.combine(one, two, "intersection", ["mask_id"]), np.minimum),
        (runs.without(one, two, ["mask_id"]), lambda x, y: np.where(y > 0, 0, x)),
        (runs.prompted(one, two, "negative", ["mask_id"]), lambda x, y: y),
    ):
        assert got.groupBy("mask_id", "y", "x1").count().where("count > 1").count() == 0
        found = back(got)
        for k in a:
            assert np.array_equal(found.get(k, np.zeros((7, 12))), want(a[k], b[k]))
    sizes = spark.createDataFrame([(k, 12, 7) for k in (*a, "other")] + [("flat", 0, 7)], "mask_id string, width int, height int")
    found = back(runs.inverted(one, sizes, ["mask_id"]))
    assert all(np.array_equal(found[k], 255 - v) for k, v in a.items()) and found["other"].all() and "flat" not in found
    with pytest.raises(ValueError):
        runs.prompted(one, two, "neither")


def test_many_masks_of_one_key(spark):
    made = arrays(3, 5)
    found = runs.of_rasters(frame(spark, made)).withColumn("image", F.lit("i"))
    twice = found.unionByName(found)  # repeated runs of a mask count once
    got = back(runs.intersection(twice, ["image"], "mask_id", 3), "image")
    assert np.array_equal(got.get("i", np.zeros((7, 12))), np.minimum.reduce(list(made.values())))
    assert np.array_equal(back(runs.union(twice, ["image"]), "image")["i"], np.maximum.reduce(list(made.values())))
    empty = found.where("y > 100")
    assert runs.union(empty, ["image"]).count() == 0 and runs.intersection(empty, ["image"], "mask_id", 1).count() == 0


def test_boxes_and_scores(spark):
    boxes = spark.createDataFrame([("a", 1, 1, 4, 3), ("a", 3, 0, 6, 2), ("a", 5, 5, 5, 9), ("b", 0, 0, 1, 1)], "image string, x1 int, y1 int, x2 int, y2 int")
    want = {(y, x) for x1, y1, x2, y2 in ((1, 1, 4, 3), (3, 0, 6, 2)) for y in range(y1, y2) for x in range(x1, x2)}
    found = runs.of_boxes(boxes, ["image"])
    assert {(r.y, r.x) for r in runs.pixels(found, ["image"]).where("image = 'a'").collect()} == want
    part = found.withColumn("part", F.lit("p"))
    people = spark.createDataFrame([("a", 0, (0.5, 0.0, 4.5, 2.5)), ("a", 1, (50.0, 50.0, 60.0, 60.0)), ("z", 0, (0.0, 0.0, 1.0, 1.0))], "image string, person_id int, bbox struct<x1: double, y1: double, x2: double, y2: double>")
    got = {r.person_id: r.score for r in runs.matches(part, people).collect()}
    shared = sum(0.5 <= x < 4.5 and 0 <= y < 2.5 for y, x in want)
    cx, cy = np.mean([x for _, x in want]), np.mean([y for y, _ in want])
    far = np.hypot(cx - 2.5, cy - 1.25) / np.hypot(4, 2.5)
    assert set(got) == {0, 1} and np.isclose(got[0], 0.4 * shared / (len(want) + 10 - shared) + 0.3 * (1 - far) + 0.3 * shared / len(want)) and got[1] == 0


def test_merged_files_by_operation(spark):
    rows = [("i", 0, 2, 2, bytearray([255, 10, 0, 255])), ("i", 1, 1, 1, bytearray([200])), ("i", 2, None, None, None), ("j", 0, None, None, None)]
    rasters = spark.createDataFrame(rows, "image string, place int, width int, height int, raster binary")
    got = {op: masks.merged_files(rasters, operation=op).collect() for op in ("union", "intersection")}
    assert [list(r.raster) for r in got["union"]] == [[255, 200, 200, 255]] and [list(r.raster) for r in got["intersection"]] == [[200, 10, 0, 200]]
    share = masks.covered_share(masks.merged_files(rasters, operation="intersection")).collect()
    assert [(r.mask_pixels, r.mask_ratio_percent) for r in share] == [(3, 75.0)]
    assert [tuple(r) for r in masks.covered_share(frame(spark, {})).collect()] == [("none", None, None)]
    with pytest.raises(ValueError):
        masks.merged_files(rasters, operation="xor")


def test_boxes_are_dealt_whole(spark):
    made = [("a", -3, 5, 4, 2 * runs.BAND + 9), ("a", 2, runs.BAND - 1, 9, runs.BAND + 1), ("b", 0, 0, 2, 1), ("a", 4, 7, 5, 8), (None, 1, 1, 2, 2), ("b", 3, 3, 3, 9)]
    boxes = spark.createDataFrame(made, "image string, x1 int, y1 long, x2 int, y2 long")
    found = runs.of_boxes(boxes, ["image"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and dict(found.dtypes) == {"image": "string", "y": "bigint", "x1": "int", "x2": "int"}
    want = {(k, y, x) for k, x1, y1, x2, y2 in made for y in range(y1, y2) for x in range(x1, x2)}
    got = [(r.image, r.y, x) for r in found.collect() for x in range(r.x1, r.x2)]
    assert len(got) == len(want) and set(got) == want


def test_rasters_of_boxes(spark):
    made = [("a", -3, 5, 4, 9), ("a", 2, 1, 9, 3), ("b", 20, 0, 22, 1), ("c", 10, 6, 40, 70)]
    boxes = spark.createDataFrame(made, "image string, x1 int, y1 int, x2 int, y2 int")
    found = masks.drawn(boxes, "image", F.lit(12), F.lit(7))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.mask_id: np.frombuffer(r.raster, np.uint8).reshape(7, 12) for r in found.collect()}
    want = back(runs.of_boxes(boxes, ["image"]).where("image <> 'b'"), "image")
    assert set(got) == {"a", "c"} and all(np.array_equal(got[k], want[k]) for k in got)
    pixels = masks.pixels_of(found)
    again = masks.rasterized(pixels, "mask_id", F.lit(12), F.lit(7)).collect()
    assert pixels.count() == sum(int((v > 0).sum()) for v in got.values()) and {r.mask_id: bytes(r.raster) for r in again} == {k: v.tobytes() for k, v in got.items()}


def test_raster_queries_make_no_pixel_rows_before_rasters(spark, tmp_path):
    from tessera.plans import rasters

    spark.range(20).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for made in (rasters._rasters(spark, str(tmp_path)), rasters._part_rasters(spark, str(tmp_path))):
        assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
