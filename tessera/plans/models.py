"""Queries of the model chains, with stubs for models whose answers follow from pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import detectors, inference, masks, runs, scores, skeleton
from ..sources.tables import table
from .registry import query


def _images(spark, d, width, height, channels=1):
    """An image a supplier: each byte is (place * 7 + key) mod 256."""
    k = F.col("s_suppkey")
    byte = lambda i: F.lpad(F.hex((i * 7 + k) % 256), 2, "0")
    raster = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(width * height * channels - 1)), byte), ""))
    return masks.dealt(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey").select(k.alias("image"), F.lit(width).alias("width"), F.lit(height).alias("height"), raster.alias("raster"))


def _refiner(name):
    """Every other pixel of a box, the pixels around a point without those marked; fails for some images, sees nothing in others."""

    def ask(view, boxes, points, labels):
        if view[0, 0] % 7 == 0:
            raise RuntimeError("no answer")
        if view[0, 0] % 5 == 0:
            return []
        y, x = np.mgrid[: view.shape[0], : view.shape[1]]
        out = [(x >= x1) & (x < x2) & (y >= y1) & (y < y2) & ((x + y) % 2 == 0) for x1, y1, x2, y2 in boxes]
        near = lambda p: abs(x - p[0]) + abs(y - p[1])
        not_here = [near(p) == 0 for p, label in zip(points, labels, strict=True) if not label]
        for p, label in zip(points, labels, strict=True):
            if label:
                out.append((near(p) <= 2) & ~np.logical_or.reduce([np.zeros(x.shape, bool), *not_here]))
        return out

    return ask


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 256 % 7 = 0 OR s_suppkey % 256 % 5 = 0 AS lost FROM supplier),
b AS (SELECT k, lost, (k * 7 + i * 5) % 17 AS x1, (k * 5 + i * 3) % 11 AS y1, (k * 7 + i * 5) % 17 + 2 + k % 6 AS x2, (k * 5 + i * 3) % 11 + 2 + k % 4 AS y2 FROM s, LATERAL (SELECT unnest([0, 1]) AS i)),
h AS (SELECT k, lost, round_even((x1 + x2) / 2 - (x2 - x1) * 0.25::DOUBLE, 0)::INT AS x1, round_even((x1 + x2) / 2 + (x2 - x1) * 0.25::DOUBLE, 0)::INT AS z, round_even((y1 + y2) / 2 - (y2 - y1) * 0.25::DOUBLE, 0)::INT AS y1,
  round_even((y1 + y2) / 2 + (y2 - y1) * 0.25::DOUBLE, 0)::INT AS w FROM b),
g AS (SELECT y::INT AS y, x::INT AS x FROM (SELECT unnest(range(0, 16)) AS y), LATERAL (SELECT unnest(range(0, 24)) AS x)),
m AS (SELECT k, 'model' AS source, g.y, g.x FROM b JOIN g ON NOT lost AND g.x >= x1 AND g.x < x2 AND g.y >= y1 AND g.y < y2 AND (g.x + g.y) % 2 = 0
  UNION SELECT k, 'boxes', g.y, g.x FROM h JOIN g ON lost AND g.x >= x1 AND g.x < greatest(z, x1 + 1) AND g.y >= y1 AND g.y < greatest(w, y1 + 1)
  UNION SELECT k, 'model', g.y, g.x FROM s JOIN g ON NOT lost AND k % 2 = 0 AND abs(g.x - k * 3 % 24) + abs(g.y - k * 11 % 16) <= 2 AND NOT (k % 4 = 0 AND g.x = k * 3 % 24 + 1 AND g.y = k * 11 % 16))
SELECT k AS image, source, y, x FROM m"""
)
def refined_masks(spark, d):
    """Masks of boxes and points by a model that fails for some images, where shrunk boxes stand."""
    k = F.col("s_suppkey")
    x, y = ((k * 7 + F.col("i") * 5) % 17).cast("int"), ((k * 5 + F.col("i") * 3) % 11).cast("int")
    s = table(spark, d, "supplier")
    box = geometry.box(x, y, (x + 2 + k % 6).cast("int"), (y + 2 + k % 4).cast("int"))
    spot = lambda by: F.struct((k * 3 % 24 + by).cast("int").alias("x"), (k * 11 % 16).cast("int").alias("y"))
    boxed = s.withColumn("i", F.explode(F.array(F.lit(0), F.lit(1)))).select(k.alias("image"), box.alias("box"), F.lit(None).cast("struct<x: int, y: int>").alias("point"), F.lit(None).cast("boolean").alias("positive"))
    none = F.lit(None).cast(boxed.schema["box"].dataType).alias("box")
    dots = s.where("s_suppkey % 2 = 0").select(k.alias("image"), none, spot(0).alias("point"), F.lit(None).cast("boolean").alias("positive"))
    less = s.where("s_suppkey % 4 = 0").select(k.alias("image"), none, spot(1).alias("point"), F.lit(False).alias("positive"))
    found = inference.refined(_images(spark, d, 24, 16), boxed.unionByName(dots).unionByName(less), _refiner, "refiner", 0.5)
    covered = runs.pixels(runs.of_rasters(found), ["mask_id"]).join(found.select("mask_id", "source"), "mask_id")
    return covered.select(F.col("mask_id").alias("image"), "source", "y", "x")


def _heatmaps(spark, d):
    """17 maps of 8 x 8 a vector, each with its values in another order; two persons an image."""
    v = F.col("vec_id")
    x, y = (v % 20).cast("int"), (v % 15).cast("int")
    maps = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(16)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", (i * (2 * c + 1) + c) % 64))))
    return table(spark, d, "embeddings").select(
        F.floor(v / 2).alias("image"), F.lit(120).alias("width"), F.lit(80).alias("height"), (v % 2).alias("person"),
        geometry.box(x, y, (x + 40 + v % 30).cast("int"), (y + 30 + v % 20).cast("int")).alias("bbox"), F.lit(8).alias("rows"), F.lit(8).alias("columns"), maps.alias("values"),
    )


POSES = """h AS (SELECT vec_id AS v, c::INT AS idx, list_transform(range(0, 64), lambda i: embedding[(i * (2 * c + 1) + c) % 64 + 1]) AS m FROM embeddings, LATERAL (SELECT unnest(range(0, 17)) AS c)),
a AS (SELECT v, idx, list_max(m)::DOUBLE AS conf, list_position(m, list_max(m)) - 1 AS p FROM h),
k AS (SELECT v // 2 AS image, v % 2 AS person, idx, trunc(v % 20 + (p % 8) / 8 * (40 + v % 30))::INT AS x, trunc(v % 15 + (p // 8) / 8 * (30 + v % 20))::INT AS y, conf FROM a)"""


@query(f"WITH {POSES} SELECT image, person, idx, x, y, round(conf, 6) AS conf FROM k")
def pose_keypoints(spark, d):
    """Keypoints of persons from heatmaps."""
    return inference.keypoints(_heatmaps(spark, d)).select("image", "person", "idx", "x", "y", F.round("conf", 6).alias("conf"))


@query(
    f"""WITH {POSES}, l AS (SELECT a.image, a.x AS xa, a.y AS ya, b.x - a.x AS dx, b.y - a.y AS dy FROM (VALUES (5, 7), (7, 9), (6, 8), (8, 10)) t(i, j) JOIN k a ON a.idx = i JOIN k b ON b.idx = j AND b.image = a.image AND b.person = a.person
  WHERE a.conf >= 0.1 AND b.conf >= 0.1),
g AS (SELECT l.*, y::INT AS y, x::INT AS x FROM l, LATERAL (SELECT unnest(range(greatest(0, least(ya, ya + dy) - 4), least(80, greatest(ya, ya + dy) + 5))) AS y), LATERAL (SELECT unnest(range(greatest(0, least(xa, xa + dx) - 4), least(120, greatest(xa, xa + dx) + 5))) AS x)),
t AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE least(1, greatest(0, ((x - xa) * dx + (y - ya) * dy)::DOUBLE / (dx * dx + dy * dy))) END AS t FROM g),
p AS (SELECT DISTINCT image, y, x FROM t WHERE (x - xa - t * dx) * (x - xa - t * dx) + (y - ya - t * dy) * (y - ya - t * dy) <= 16),
n AS (SELECT image, count(*)::INT AS pieces FROM l GROUP BY 1)
SELECT image, pieces, count(*) AS pixels, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy FROM p JOIN n USING (image) GROUP BY 1, 2"""
)
def pose_masks(spark, d):
    """Arms drawn from keypoints: pieces, pixels and where they lie."""
    drawn = skeleton.skeleton_masks(inference.keypoints(_heatmaps(spark, d)), "arms", 0.1, soft=False).withColumnRenamed("image", "mask_id")
    covered = runs.pixels(runs.of_rasters(drawn), ["mask_id"]).groupBy("mask_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    return covered.join(drawn.select("mask_id", "pieces"), "mask_id").select(F.col("mask_id").alias("image"), "pieces", "pixels", "sx", "sy")


#: Four regions an image of 64 x 48, some of them small, over its edge or outside it.
REGIONS = """r AS (SELECT s_suppkey AS image, i AS region, (s_suppkey * 13 + i * 29) % 70 - 4 AS x1, (s_suppkey * 17 + i * 11) % 56 - 4 AS y1, (s_suppkey * 13 + i * 29) % 70 - 4 + 3 + (s_suppkey + i * 7) % 40 AS x2,
  (s_suppkey * 17 + i * 11) % 56 - 4 + 3 + (s_suppkey * 3 + i) % 44 AS y2 FROM supplier, LATERAL (SELECT unnest(range(0, 4)) AS i))"""


def _regions(spark, d):
    k, i = F.col("s_suppkey"), F.col("region")
    x, y = ((k * 13 + i * 29) % 70 - 4).cast("int"), ((k * 17 + i * 11) % 56 - 4).cast("int")
    rows = table(spark, d, "supplier").withColumn("region", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return rows.select(k.alias("image"), "region", geometry.box(x, y, (x + 3 + (k + i * 7) % 40).cast("int"), (y + 3 + (k * 3 + i) % 44).cast("int")).alias("bbox"))


def _reader(name):
    """Names a crop by its first pixel and size; blank for some, fails for some."""

    def read(views):
        out = []
        for v in views:
            if v.size % 5 == 0:
                raise RuntimeError("no answer")
            out.append(" " if v.size % 3 == 0 else f" {v[0, 0]}:{v.shape[1]}x{v.shape[0]}")
        return out

    return read


@query(
    f"""WITH {REGIONS}, m AS (SELECT *, greatest(2, floor(least(x2 - x1, y2 - y1) * 0.05))::INT AS e FROM r),
c AS (SELECT image, region, greatest(0, x1 - e) AS x1, greatest(0, y1 - e) AS y1, least(64, x2 + e) AS x2, least(48, y2 + e) AS y2 FROM m)
SELECT image, region, CASE WHEN (x2 - x1) * (y2 - y1) % 5 = 0 THEN '' ELSE ((y1 * 64 + x1) * 7 + image) % 256 || ':' || (x2 - x1) || 'x' || (y2 - y1) END AS text
FROM c WHERE x2 > x1 AND y2 > y1 AND ((x2 - x1) * (y2 - y1) % 5 = 0 OR (x2 - x1) * (y2 - y1) % 3 > 0)"""
)
def text_crops(spark, d):
    """Regions in whose crops a model reads text; those that it fails on stay."""
    return inference.text_regions(_images(spark, d, 64, 48), _regions(spark, d), _reader)


def _dresser(name):
    """Tags of a crop from its size; fails for some."""

    def tag(views):
        if any(v.shape[1] % 4 == 0 for v in views):
            raise RuntimeError("no answer")
        return [{"girl": v.shape[1] % 10 / 10.0, "boy": v.shape[0] % 10 / 10.0, "hat": 1.0} for v in views]

    return tag


@query(
    f"""WITH {REGIONS}, c AS (SELECT image, region, least(64, x2) - greatest(0, x1) AS w, least(48, y2) - greatest(0, y1) AS h FROM r),
s AS (SELECT *, w % 10 / 10::DOUBLE AS g, h % 10 / 10::DOUBLE AS b, w >= 20 AND h >= 20 AND w % 4 > 0 AS asked FROM c)
SELECT image, region AS person_id, CASE WHEN asked AND b > g AND b >= 0.5 THEN 'male' ELSE 'female' END AS gender, CASE WHEN NOT asked THEN 0.5 WHEN b > g AND b >= 0.5 THEN b WHEN g >= 0.5 THEN g ELSE 0.5 END AS confidence FROM s"""
)
def person_genders(spark, d):
    """Genders by the tags of crops; small crops and those that a model fails on have the default."""
    people = _regions(spark, d).withColumnRenamed("region", "person_id")
    return inference.genders(_images(spark, d, 64, 48), people, _dresser, ["girl"], ["boy"])


def _segmenter(name):
    """A band of rows at the lower scales, columns at the highest, with masks of the image's size or twice as large; another label each time."""

    def see(view, scale):
        wide, key = 560, int(view[0, 0])
        mask = np.zeros((4, wide))
        if scale == 1280:
            raise RuntimeError("too large")
        if scale == 640:
            mask[1, : 100 + key] = 1
            return [("part", 0.5, mask), ("other", 0.9, np.ones((4, wide)))]
        mask[:, 10 : 20 + key] = 1
        return [("part", 0.75, np.kron(mask, np.ones((2, 2))))]

    return see


@query(
    """WITH s AS (SELECT s_suppkey AS image, s_suppkey % 256 AS key FROM supplier),
p AS (SELECT image, 1 AS y, x FROM s, LATERAL (SELECT unnest(range(0, 100 + key)) AS x) UNION SELECT image, y, x FROM s, LATERAL (SELECT unnest(range(0, 4)) AS y), LATERAL (SELECT unnest(range(10, 20 + key)) AS x))
SELECT image, count(*) AS pixels, sum(x)::BIGINT AS sx, sum(y)::BIGINT AS sy, 2::BIGINT AS count, 0.625::DOUBLE AS confidence FROM p GROUP BY 1"""
)
def scale_masks(spark, d):
    """Detections of images of 560 x 4 at the scales that are not beyond twice their side, joined at their size."""
    k = F.col("s_suppkey")
    raster = F.unhex(F.repeat(F.lpad(F.hex(k % 256), 2, "0"), 560 * 4))
    images = table(spark, d, "supplier").select(k.alias("image"), F.lit(560).alias("width"), F.lit(4).alias("height"), raster.alias("raster"))
    found = inference.detections(images, _segmenter)
    covered, seen = inference.over_scales(found, ["part"])
    sums = runs.pixels(covered, ["image"]).groupBy("image").agg(F.count(F.lit(1)).alias("pixels"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    return sums.join(seen, "image")


@query(
    """WITH i AS (SELECT unnest(range(0, 24 * 16 * 3)) AS i)
SELECT s_suppkey AS image, (2 - i % 3)::INT AS channel, count(*)::BIGINT + 24 * 8 AS pixels, sum((i * 7 + s_suppkey) % 256)::BIGINT + 24 * 8 * 255 AS total FROM supplier, i GROUP BY 1, 2"""
)
def model_inputs(spark, d):
    """Pictures on white squares as a model takes them, counted back to bytes by channel, blue first."""
    made = inference.model_inputs(_images(spark, d, 24, 16, 3), 24)
    rows = made.select("image", F.posexplode("input").alias("at", "v"))
    value = F.round((F.col("v").cast("double") * 0.5 + 0.5) * 255).cast("long")
    return rows.groupBy("image", F.floor(F.col("at") / (24 * 24)).cast("int").alias("channel")).agg(F.count(F.lit(1)).alias("pixels"), F.sum(value).alias("total"))


@query(
    """WITH o AS (SELECT vec_id AS image, CASE WHEN vec_id % 2 = 0 THEN embedding[9:16] ELSE embedding[1:8] END AS l FROM embeddings),
p AS (SELECT image, i::INT AS idx, 1 / (1 + exp(-l[i + 1]::DOUBLE)) AS p FROM o, LATERAL (SELECT unnest(range(0, 8)) AS i))
SELECT image, idx, 'tag' || idx AS tag, CASE WHEN idx % 3 = 0 THEN 'character' ELSE 'general' END AS category, round(p, 6) AS probability FROM p WHERE p >= CASE WHEN idx % 3 = 0 THEN 0.52 ELSE 0.48 END"""
)
def second_outputs(spark, d):
    """Tags by the second of a model's outputs, or by its only one."""
    cut = lambda a: F.slice("embedding", a, 8)
    outputs = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.when(F.col("vec_id") % 2 == 0, F.array(cut(1), cut(9))).otherwise(F.array(cut(1))).alias("outputs"))
    idx = F.col("id").cast("int")
    words = spark.range(8).select(idx.alias("idx"), F.concat(F.lit("tag"), idx).alias("tag"), F.when(idx % 3 == 0, "character").otherwise("general").alias("category"))
    rows = detectors.second_output(outputs).withColumn("logit", F.col("logit").cast("double"))
    return scores.above(scores.named(rows, words), 0.48, 0.52).select("image", "idx", "tag", "category", F.round("probability", 6).alias("probability"))


def _engine(name):
    return lambda views: [{f"tag{j}": (int(v[0, 0]) * (j + 1) % 10) / 10 for j in range(5)} for v in views]


@query(
    """WITH t AS (SELECT s_suppkey AS image, j, s_suppkey % 256 * (j + 1) % 10 AS p FROM supplier, LATERAL (SELECT unnest(range(0, 5)) AS j)),
m AS (SELECT s_suppkey AS image, list_sort(CASE WHEN s_nationkey % 2 = 0 THEN ['found', 'tag1'] ELSE [] END) AS l FROM supplier),
k AS (SELECT image, list('tag' || j) FILTER (WHERE p >= 4) AS l FROM t GROUP BY 1)
SELECT image, list_sort(list_distinct(list_concat(m.l, coalesce(k.l, [])))) AS tags, CASE WHEN len(m.l) > 0 AND k.l IS NOT NULL THEN 'both' WHEN len(m.l) > 0 THEN 'lookup' WHEN k.l IS NOT NULL THEN 'tagger' ELSE 'none' END AS found_by FROM m JOIN k USING (image)"""
)
def combined_tags(spark, d):
    """Tags that were looked up, joined with those that an engine names."""
    images = _images(spark, d, 2, 2)
    named = detectors.engine_tags(images, _engine).groupBy("image").agg(F.collect_set("tag").alias("tags"))
    known = table(spark, d, "supplier").where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("image"), F.array(F.lit("found"), F.lit("tag1")).alias("tags"))
    return detectors.combined_tags(images, known, named)


@query("""SELECT s_suppkey AS image, 'tag' || j AS tag, (s_suppkey % 256 * (j + 1) % 10) / 10::DOUBLE AS probability FROM supplier, LATERAL (SELECT unnest(range(0, 5)) AS j)""")
def engine_tags(spark, d):
    """All tags that an engine names."""
    return detectors.engine_tags(_images(spark, d, 2, 2), _engine, least=None)


@query(
    """WITH p AS (SELECT p_partkey % 500 AS image, p_brand AS tag, CASE WHEN p_size % 2 = 0 THEN 'character' ELSE 'general' END AS category, p_size / 50 AS probability FROM part),
k AS (SELECT image, category, tag FROM p WHERE probability > CASE WHEN category = 'character' THEN 0.6 ELSE 0.3 END)
SELECT image, category, tag, 1.0::DOUBLE AS score FROM k
UNION ALL SELECT DISTINCT image, 'ip', 'series ' || right(tag, 1), 1.0::DOUBLE FROM k WHERE category = 'character'"""
)
def handler_tags(spark, d):
    """Tags over strict thresholds, each as certain, with the sources of the characters."""
    p = table(spark, d, "part")
    rows = p.select((F.col("p_partkey") % 500).alias("image"), F.col("p_brand").alias("tag"), F.when(F.col("p_size") % 2 == 0, "character").otherwise("general").alias("category"), (F.col("p_size") / 50).alias("probability"))
    return detectors.handler_tags(rows, 0.3, 0.6, p.select(F.col("p_brand").alias("character"), F.concat(F.lit("series "), F.right("p_brand", F.lit(1))).alias("ip")).distinct())


SMALL = """b AS (SELECT s_suppkey AS image, i, (s_suppkey * 7 + i * 5) % 17 AS x1, (s_suppkey * 5 + i * 3) % 11 AS y1, (s_suppkey * 7 + i * 5) % 17 + 2 + s_suppkey % 6 AS x2, (s_suppkey * 5 + i * 3) % 11 + 2 + s_suppkey % 4 AS y2
  FROM supplier, LATERAL (SELECT unnest(range(0, 4)) AS i))"""


def _small_boxes(spark, d):
    """Four boxes a supplier on images of 24 x 16."""
    k, i = F.col("s_suppkey"), F.col("i")
    x, y = ((k * 7 + i * 5) % 17).cast("int"), ((k * 5 + i * 3) % 11).cast("int")
    rows = table(spark, d, "supplier").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return rows.select(k.alias("image"), "i", x.alias("x1"), y.alias("y1"), (x + 2 + k % 6).cast("int").alias("x2"), (y + 2 + k % 4).cast("int").alias("y2"))


@query(
    f"""WITH {SMALL}, p AS (SELECT DISTINCT image, y, x FROM b, LATERAL (SELECT unnest(range(y1, y2)) AS y), LATERAL (SELECT unnest(range(x1, x2)) AS x) WHERE image % 3 > 0 AND (i < 2 OR image % 3 = 1))
SELECT s_suppkey AS image, CASE WHEN count(p.y) > 0 THEN 1 ELSE 0 END AS count, CASE WHEN count(p.y) > 0 THEN 0.3::DOUBLE ELSE 0 END AS confidence, count(p.y) AS pixels FROM supplier LEFT JOIN p ON p.image = s_suppkey GROUP BY 1"""
)
def segments_and_boxes(spark, d):
    """Segments joined with boxes: found or not, with the threshold as confidence."""
    b = _small_boxes(spark, d).where("image % 3 > 0")
    segments = runs.of_boxes(b.where("i < 2"), ["image"])
    images = table(spark, d, "supplier").select(F.col("s_suppkey").alias("image"))
    return detectors.segments_and_boxes(images, segments, b.where("i >= 2 AND image % 3 = 1"), 0.3)[1]


def _finder(name):
    """Boxes whose labels and scores follow from an image's first pixel; fails for some."""

    def find(view):
        key = int(view[0, 0])
        if key % 6 == 0:
            raise RuntimeError("no answer")
        return [(("cat", "dog")[(key + j) % 2], (key * (j + 3) % 10) / 10, j, j, j + 4, j + 3) for j in range(4)]

    return find


@query(
    """SELECT s_suppkey AS image, CASE WHEN (s_suppkey % 256 + j) % 2 = 0 THEN 'cat' ELSE 'dog' END AS label, (s_suppkey % 256 * (j + 3) % 10) / 10::DOUBLE AS score, j::INT AS x1, (j + 3)::INT AS y2
FROM supplier, LATERAL (SELECT unnest(range(0, 4)) AS j) WHERE s_suppkey % 256 % 6 > 0 AND (s_suppkey % 256 + j) % 2 = 1 AND s_suppkey % 256 * (j + 3) % 10 >= 4"""
)
def custom_detections(spark, d):
    """Detections of one label of a custom model over its threshold."""
    found = detectors.custom(_images(spark, d, 2, 2), _finder, "models/own.pt", 0.4, ["dog"])
    return found.select("image", "label", "score", F.col("bbox.x1").alias("x1"), F.col("bbox.y2").alias("y2"))


@query(
    f"""WITH {SMALL}, w AS (SELECT image, i, x1, y1, x2, y2, (image * (i + 3) % 97) / 97::DOUBLE AS score FROM b WHERE i <> 3),
n AS (SELECT a.image, a.i FROM w a JOIN w c ON c.image = a.image AND c.i <> a.i AND (c.score > a.score) WHERE a.i < 2 AND c.i < 2
  AND (least(a.x2, c.x2) - greatest(a.x1, c.x1)) > 0 AND (least(a.y2, c.y2) - greatest(a.y1, c.y1)) > 0
  AND 2 * (least(a.x2, c.x2) - greatest(a.x1, c.x1)) * (least(a.y2, c.y2) - greatest(a.y1, c.y1)) > (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) - (least(a.x2, c.x2) - greatest(a.x1, c.x1)) * (least(a.y2, c.y2) - greatest(a.y1, c.y1))),
k AS (SELECT * FROM w ANTI JOIN n USING (image, i)),
e AS (SELECT image, count(*) AS count, avg(score) AS confidence FROM k GROUP BY 1),
m AS (SELECT DISTINCT k.image, y, x FROM k, LATERAL (SELECT unnest(range(y1, y2)) AS y), LATERAL (SELECT unnest(range(x1, x2)) AS x) WHERE (image % 256 % 7 = 0 OR image % 256 % 5 = 0 OR (x + y) % 2 = 0))
SELECT image, CASE WHEN image % 256 % 7 = 0 OR image % 256 % 5 = 0 THEN 'boxes' ELSE 'model' END AS source, count, round(confidence, 6) AS confidence, count(*) AS pixels FROM m JOIN e USING (image) GROUP BY ALL"""
)
def refined_detections(spark, d):
    """Detections of two labels, suppressed within each, refined to masks with their boxes as the fallback."""
    i = F.col("i")
    score = (F.col("image") * (i + 3) % 97) / 97
    b = _small_boxes(spark, d).select("image", F.when(i < 2, "a").when(i == 2, "b").otherwise("c").alias("label"), geometry.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("bbox"), score.alias("score"))
    found, seen = detectors.refined_boxes(_images(spark, d, 24, 16), b, _refiner, ["a", "b"], overlap=0.5)
    area = runs.areas(runs.of_rasters(found), ["mask_id"])
    rows = found.select("mask_id", "source").join(area, "mask_id").withColumnRenamed("mask_id", "image").join(seen, "image")
    return rows.select("image", "source", "count", F.round("confidence", 6).alias("confidence"), "pixels")


@query(
    f"""WITH {SMALL}, m AS (SELECT image, i, x1, y1, x2, y2, CASE WHEN i = 0 THEN 'one' ELSE 'two' END AS part, (i + 1) / 10::DOUBLE AS confidence FROM b WHERE i < 3),
c AS (SELECT image, part, count(*) AS n, avg(confidence) AS confidence FROM m GROUP BY 1, 2),
p AS (SELECT DISTINCT image, part, y, x FROM m, LATERAL (SELECT unnest(range(y1, y2)) AS y), LATERAL (SELECT unnest(range(x1, x2)) AS x)),
s AS (SELECT image, part, count(*) AS pixels FROM p GROUP BY 1, 2)
SELECT image, part, n AS count, round(confidence, 6) AS confidence, pixels FROM s JOIN c USING (image, part) WHERE part = 'two' OR pixels >= 0.03 * 384"""
)
def sensitive_parts(spark, d):
    """Masks of labels joined to parts, a part without those of a small share, counted by regions and detections."""
    b = _small_boxes(spark, d).where("i < 4").withColumn("key", F.struct("image", "i"))
    rasters = runs.rasterized(runs.of_boxes(b, ["key"]), "key", F.lit(24), F.lit(16))
    i = F.col("mask_id.i")
    found = rasters.select("mask_id.image", F.concat(F.lit("l"), i).alias("label"), ((i + 1) / 10).alias("confidence"), "width", "height", "raster")
    steps = table(spark, d, "region").where("r_regionkey = 0").select(F.lit("one").alias("part"), *[F.lit(None if c != "min_share" else 0.03).alias(c) for c in masks.STEPS])
    parts = detectors.sensitive_parts(found, {"one": ["l0"], "two": ["l1", "l2"]}, steps)
    size = masks.covered_share(parts.withColumn("mask_id", F.struct("image", "part"))).select("mask_id.image", "mask_id.part", F.col("mask_pixels").alias("pixels"))
    return parts.join(size, ["image", "part"]).select("image", "part", "count", F.round("confidence", 6).alias("confidence"), "pixels")


@query(
    f"""WITH {SMALL}, g AS (SELECT image, i // 2 AS person, CASE WHEN (image + i // 2) % 2 = 0 THEN 'male' ELSE 'female' END AS gender, 'part' || i AS part, y, x FROM b, LATERAL (SELECT unnest(range(y1, y2)) AS y), LATERAL (SELECT unnest(range(x1, x2)) AS x)),
f AS (SELECT 'default' AS option, image, 'mask_' || person || '_' || gender || '_merged.png' AS file, y, x FROM g UNION SELECT 'default', image, 'mask_all_merged.png', y, x FROM g
  UNION SELECT 'all', image, 'm_' || person || '_' || gender || '_' || part || '.png', y, x FROM g UNION SELECT 'all', image, 'm_mask.png', y, x FROM g)
SELECT option, image, file, CASE WHEN option = 'all' THEN 384 - count(*) ELSE count(*) END AS pixels FROM f GROUP BY 1, 2, 3"""
)
def saved_masks(spark, d):
    """Masks by person and part under the names of each option; the second lot inverted."""
    b, i = _small_boxes(spark, d), F.col("i")
    person = F.floor(i / 2)
    gender = F.when((F.col("image") + person) % 2 == 0, "male").otherwise("female")
    keys = ["image", "person_id", "gender", "part", "width", "height"]
    parts = runs.of_boxes(b.select("image", person.alias("person_id"), gender.alias("gender"), F.concat(F.lit("part"), i).alias("part"), F.lit(24).alias("width"), F.lit(16).alias("height"), "x1", "y1", "x2", "y2"), keys)
    out = None
    for option, found in (("default", detectors.saved_masks(parts)), ("all", detectors.saved_masks(parts, "m", True, True, True))):
        named = masks.covered_share(found.withColumn("mask_id", F.struct("image", "file")))
        one = named.select(F.lit(option).alias("option"), "mask_id.image", "mask_id.file", F.col("mask_pixels").alias("pixels"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH r AS (SELECT vec_id AS image, vec_id % 3 AS m, 300 + vec_id % 200 AS w, 200 + vec_id % 300 AS h, (i * 23 + vec_id * 7) % 600 + 0.5::DOUBLE AS cx, (i * 41 + vec_id * 3) % 600 + 0.25::DOUBLE AS cy, 20 + (i * 13 + vec_id) % 150 AS bw, 10 + (i * 17 + vec_id) % 90 AS bh,
  list_transform(embedding[i * 4 + 1:i * 4 + 1 + CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 0 END], lambda x: x::DOUBLE) AS s FROM embeddings, LATERAL (SELECT unnest(range(0, 6)) AS i)),
k AS (SELECT *, list_max(s) AS score, 640::DOUBLE / greatest(w, h) AS scale, (640 - w * 640::DOUBLE / greatest(w, h)) / 2 AS pw, (640 - h * 640::DOUBLE / greatest(w, h)) / 2 AS ph FROM r),
b AS (SELECT image, list_position(s, score) - 1 AS label, score, greatest(0, trunc((cx - bw / 2 - pw) / scale))::INT AS x1, greatest(0, trunc((cy - bh / 2 - ph) / scale))::INT AS y1, least(w, trunc((cx + bw / 2 - pw) / scale))::INT AS x2,
  least(h, trunc((cy + bh / 2 - ph) / scale))::INT AS y2 FROM k WHERE score >= 0.05)
SELECT image, label::INT AS label, x1, y1, x2, y2, round(score, 6) AS score FROM b WHERE x2 > x1 AND y2 > y1"""
)
def centre_boxes(spark, d):
    """Boxes of a letterboxed model's rows, some with one score and some with three."""
    v, i = F.col("vec_id"), F.col("i")
    w, h = (300 + v % 200).cast("int"), (200 + v % 300).cast("int")
    scale = 640.0 / F.greatest(w, h)
    values = [(i * 23 + v * 7) % 600 + 0.5, (i * 41 + v * 3) % 600 + 0.25, (20 + (i * 13 + v) % 150).cast("double"), (10 + (i * 17 + v) % 90).cast("double")]
    some = F.transform(F.slice("embedding", i * 4 + 1, F.when(v % 2 == 0, 3).otherwise(1)), lambda x: x.cast("double"))
    rows = table(spark, d, "embeddings").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5))))
    outputs = rows.select(
        v.alias("image"), w.alias("width"), h.alias("height"), scale.alias("scale"), ((640 - w * scale) / 2).alias("pad_w"), ((640 - h * scale) / 2).alias("pad_h"), F.concat(F.array(*values), some).alias("row")
    )
    found = detectors.centre_boxes(outputs, 0.05)
    return found.select("image", "label", "bbox.*", F.round("score", 6).alias("score"))


@query(
    f"""WITH {SMALL}, p AS (SELECT DISTINCT image, y, x FROM b, LATERAL (SELECT unnest(range(y1, y2)) AS y), LATERAL (SELECT unnest(range(x1, x2)) AS x)), s AS (SELECT image, count(*) AS pixels FROM p GROUP BY 1)
SELECT image, 4::BIGINT AS count, 0.25::DOUBLE AS confidence, pixels FROM s"""
)
def boxes_only(spark, d):
    """All boxes as one mask, with their number and mean score."""
    b = _small_boxes(spark, d)
    covered, seen = detectors.boxes_only(b.select("image", geometry.box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]).alias("bbox"), ((F.col("i") + 1) / 10).alias("score")))
    return runs.areas(covered, ["image"]).join(seen, "image").select("image", "count", F.round("confidence", 6).alias("confidence"), "pixels")


@query(
    f"""WITH RECURSIVE {SMALL}, p AS (SELECT DISTINCT image, y, x, y * 24 + x AS id FROM b, LATERAL (SELECT unnest(range(y1, y2)) AS y), LATERAL (SELECT unnest(range(x1, x2)) AS x) WHERE i < 3),
r AS (SELECT image, id, y, x, id AS seen FROM p UNION SELECT r.image, r.id, m.y, m.x, m.id FROM r JOIN p m ON m.image = r.image AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1),
l AS (SELECT image, id, min(seen) AS label FROM r GROUP BY 1, 2),
k AS (SELECT image, label, min(p.x) AS x1, min(p.y) AS y1, max(p.x) + 1 AS x2, max(p.y) + 1 AS y2, count(*) AS area FROM l JOIN p USING (image, id) GROUP BY 1, 2),
m AS (SELECT *, greatest(2, floor(least(x2 - x1, y2 - y1) * 0.05))::INT AS e FROM k WHERE x2 - x1 >= 3 AND y2 - y1 >= 3),
c AS (SELECT image, area, (least(24, x2 + e) - greatest(0, x1 - e)) * (least(16, y2 + e) - greatest(0, y1 - e)) AS n FROM m)
SELECT image, count(*) AS count, sum(area)::BIGINT AS pixels FROM c WHERE n % 5 = 0 OR n % 3 > 0 GROUP BY 1"""
)
def text_bubbles(spark, d):
    """Regions of masks in whose crops a model reads text, joined again."""
    rasters = runs.rasterized(runs.of_boxes(_small_boxes(spark, d).where("i < 3"), ["image"]), "image", F.lit(24), F.lit(16))
    covered, seen = detectors.text_bubbles(_images(spark, d, 24, 16), rasters, _reader, "bubbles")
    return runs.areas(covered, ["image"]).join(seen, "image").select("image", "count", "pixels")
