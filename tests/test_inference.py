"""Model chains on small images, failing models among them."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from tessera.operators import inference, masks, runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import the tests
IMAGE = "image string, width int, height int, raster binary"
BOX = "struct<x1: int, y1: int, x2: int, y2: int>"


def image(name, w, h, fill=0, channels=1):
    return (name, w, h, bytearray([fill] * (w * h * channels)))


def no_model(name):
    raise OSError("no such model")


def half(name):
    def ask(view, boxes, points, labels):
        if view.flat[0] == 9:
            raise ValueError
        if view.flat[0] == 8:
            return [np.zeros((2, 2))]
        mask = np.zeros(view.shape[:2])
        mask[:, : mask.shape[1] // 2] = 1
        return [mask] if boxes else [np.ones((2, 2)) * (sum(labels) > 0)]

    return ask


def test_refined(spark):
    images = spark.createDataFrame([image("a", 4, 2), image("b", 4, 2, 9), image("c", 4, 2, 8, 3), image("d", 4, 2), image("e", 4, 2), ("n", None, None, None)], IMAGE)
    kind = f"image string, box {BOX}, point struct<x: int, y: int>, positive boolean"
    rows = [(i, (0, 0, 4, 2), None, None) for i in "abcnz"] + [("d", (3, 1, 3, 2), None, None), ("e", None, (1, 1), None), ("b", None, (1, 1), True)]
    prompts = spark.createDataFrame(rows, kind)
    got = {r.mask_id: (r.source, np.frombuffer(r.raster, np.uint8).reshape(2, 4).astype(bool).sum(0).tolist()) for r in inference.refined(images, prompts, half, "half", 0.5).collect()}
    assert got == {"a": ("model", [2, 2, 0, 0]), "b": ("boxes", [0, 2, 2, 0]), "c": ("boxes", [0, 2, 2, 0]), "d": ("none", [0] * 4), "e": ("model", [2] * 4)}
    off = {r.mask_id: r.source for r in inference.refined(images, prompts, half, "half", 0.5, fallback=False).collect()}
    assert off == {"a": "model", "b": "none", "c": "none", "d": "none", "e": "model"}
    absent = {r.mask_id: r.source for r in inference.refined(images, prompts, no_model, "absent").collect()}
    assert absent == {"a": "boxes", "b": "boxes", "c": "boxes", "d": "none", "e": "none"}
    assert inference.refined(images.limit(0), prompts, half, "half").count() == 0


def test_crops_and_readers(spark):
    raster = bytearray(range(24))
    images = spark.createDataFrame([("a", 6, 4, raster), ("c", 2, 2, bytearray(range(12))), ("n", None, None, None)], IMAGE)
    regions = spark.createDataFrame([("a", 0, (1, 1, 3, 3)), ("a", 1, (-5, -5, 1, 1)), ("a", 2, (6, 0, 9, 9)), ("c", 0, (1, 0, 2, 2)), ("z", 0, (0, 0, 1, 1)), ("n", 0, (0, 0, 1, 1))], f"image string, region int, bbox {BOX}")
    got = {(r.image, r.region): (r.width, r.height, r.raster and list(r.raster)) for r in inference.crops(images, regions).collect()}
    assert got == {("a", 0): (2, 2, [7, 8, 13, 14]), ("a", 1): (1, 1, [0]), ("a", 2): (None, None, None), ("c", 0): (1, 2, [3, 4, 5, 9, 10, 11])}

    def reader(name):
        def read(views):
            if len(views) == 1 and views[0].size >= 20 or len(views) > 1:
                raise RuntimeError
            return [" x "]

        return read

    cut = inference.crops(images, regions)
    assert {(r.image, r.region): (r.answer, r.state) for r in inference.answers(cut, no_model, "gone", "string").collect()} == {("a", 0): (None, "absent"), ("a", 1): (None, "absent"), ("a", 2): (None, "empty"), ("c", 0): (None, "absent")}
    found = {(r.image, r.region): r.text for r in inference.text_regions(images, regions, reader, "one").collect()}
    assert found == {("a", 0): "", ("a", 1): "x", ("a", 2): "x", ("c", 0): "x"}  # the margin brings region 2 into the image; region 0 fails and stays
    assert inference.text_regions(images, regions, reader, "one", least=2).count() == 1


def test_genders(spark):
    images = spark.createDataFrame([image("a", 60, 60)], IMAGE)
    people = spark.createDataFrame([("a", 0, (0, 0, 30, 30)), ("a", 1, (0, 0, 19, 40)), ("a", 2, (50, 50, 90, 90)), ("a", 3, (0, 0, 40, 20))], f"image string, person_id int, bbox {BOX}")
    model = lambda name: lambda views: [{"1boy": 0.9} if v.shape[0] == 30 else {} for v in views]
    got = {r.person_id: (r.gender, r.confidence) for r in inference.genders(images, people, model, ["1girl"], ["1boy"], "tags").collect()}
    assert got == {0: ("male", 0.9), 1: ("female", 0.5), 2: ("female", 0.5), 3: ("female", 0.5)}
    gone = {r.gender for r in inference.genders(images, people, no_model, ["1girl"], ["1boy"], "gone").collect()}
    assert gone == {"female"}


def test_scales(spark):
    images = spark.createDataFrame([image("small", 100, 4), image("mid", 320, 2), image("large", 640, 2, 0, 3), ("n", None, None, None)], IMAGE)
    assert sorted((r.image, r.scale) for r in inference.scaled(images).collect()) == [("large", 640), ("large", 1024), ("large", 1280), ("mid", 640)]

    def see(name):
        def of(view, scale):
            assert max(view.shape[:2]) == scale
            if scale == 1280:
                raise RuntimeError
            return [("x", scale / 1000, np.ones(view.shape[:2]))]

        return of

    found = inference.detections(images, see, "see")
    assert sorted((r.image, r.scale, r.label, r.confidence, len(r.raster)) for r in found.collect()) == [("large", 640, "x", 0.64, 1280), ("large", 1024, "x", 1.024, 1280)] + [("mid", 640, "x", 0.64, 640)]
    covered, seen = inference.over_scales(found.where("image = 'large'"), ["x"])
    assert [tuple(r) for r in runs.areas(covered, ["image"]).collect()] == [("large", 1280)] and [(r["count"], round(r.confidence, 3)) for r in seen.collect()] == [(2, 0.832)]
    assert inference.over_scales(found, ["y"])[1].count() == 0


def test_keypoints(spark):
    one = [0.0] * 6
    values = [one[:k % 6] + [1.0 + k] + one[k % 6 + 1 :] for k in range(17)]
    rows = [("a", 60, 40, 0, (10, 10, 40, 30), 2, 3, sum(values, [])), ("b", 60, 40, 0, (10, 10, 40, 30), 2, 3, sum(values[:16], [])), ("c", 60, 40, 0, (10, 10, 10, 30), 2, 3, sum(values, [])), ("d", 60, 40, 0, (0, 0, 6, 4), 2, 3, [2.0] * 102), ("e", 1, 1, 0, (0, 0, 1, 1), 2, 3, None)]
    maps = spark.createDataFrame(rows, f"image string, width int, height int, person int, bbox {BOX}, rows int, columns int, values array<double>")
    got = {(r.image, r.idx): (r.x, r.y, r.conf) for r in inference.keypoints(maps).collect()}
    assert len(got) == 34 and got["a", 0] == (10, 10, 1.0) and got["a", 4] == (20, 20, 5.0) and got["a", 16] == (20, 20, 17.0) and got["d", 3] == (0, 0, 2.0)


def plain_bicubic(row, to):
    scale = len(row) / to
    wide = max(1.0, scale)
    out = []
    for i in range(to):
        centre, total, sure = (i + 0.5) * scale, 0.0, 0.0
        for j, v in enumerate(row):
            t = abs(j + 0.5 - centre) / wide
            w = 1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0.0
            total, sure = total + w * v, sure + w
        out.append(total / sure)
    return out


def test_prepared_inputs(spark):
    rng = np.random.default_rng(5)
    for size, to in ((7, 7), (12, 5), (5, 12), (1, 4)):
        row = rng.integers(0, 256, size).tolist()
        assert np.allclose(inference.bicubic(size, to) @ row, plain_bicubic(row, to))
    view = rng.integers(0, 256, (6, 9, 3)).astype(np.uint8)
    made = inference.prepared(view, 4)
    square = np.full((9, 9, 3), 255.0)
    square[1:7] = view
    step = lambda v: np.clip(np.floor(np.array(v) + 0.5), 0, 255)
    for c in range(3):
        lines = step([plain_bicubic(r, 4) for r in square[..., c]])
        want = step([plain_bicubic(r, 4) for r in lines.T]).T
        assert np.allclose(made[2 - c], (want / 255 - 0.5) / 0.5, atol=1e-6)
    clear = np.zeros((2, 2, 4), np.uint8)
    assert (inference.prepared(clear, 2) == 1).all() and inference.prepared(clear[..., 0], 3).shape == (3, 3, 3)
    rows = spark.createDataFrame([("a", 9, 6, bytearray(view.tobytes())), ("n", None, None, None)], IMAGE)
    got = {r.image: r.input for r in inference.model_inputs(rows, 4).collect()}
    assert got["n"] is None and np.allclose(got["a"], made.ravel())


def test_models_are_built_once():
    built = []
    build = lambda name: built.append(name) or (lambda: 1)
    assert inference.model_of("once", build) is inference.model_of("once", build) and built == ["once"]
    with pytest.raises(OSError):
        no_model("x")
    assert inference.model_of("never", no_model) is None
    assert masks.from_probabilities(np.ones((1, 1)), 3, 2).all()


def test_models_are_asked_in_pieces(spark):
    n = masks.MASKS_AT_ONCE + 3
    cut = spark.range(0, n, 1, 1).selectExpr("id AS image", "0 AS region", "1 AS width", "1 AS height", "CASE WHEN id % 10 > 0 THEN X'07' END AS raster")
    rows = {r.image: (r.answer, r.state) for r in inference.answers(cut, lambda name: lambda views: [str(len(views))] * len(views), "counter", "string").collect()}
    pieces = [sum(k % 10 > 0 for k in part) for part in (range(masks.MASKS_AT_ONCE), range(masks.MASKS_AT_ONCE, n))]
    assert rows == {k: (str(pieces[k >= masks.MASKS_AT_ONCE]), "asked") if k % 10 else (None, "empty") for k in range(n)}
