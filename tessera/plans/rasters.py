"""Queries of the mask operators on rasters: pixels made from the parts' keys on grids of 24 x 16."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import actions, boxes, masks, neighbors, runs, scores
from ..operators.written import Written
from ..sources import files as sources
from ..sources import jpeg, pictures, png
from ..sources.tables import table
from .registry import query

W, H = 24, 16


def _boxes(spark, d):
    """One box a part, five parts an image."""
    k = F.col("p_partkey")
    x, y = F.pmod(k * 7, F.lit(17)).cast("int"), F.pmod(k * 5, F.lit(11)).cast("int")
    corners = [x.alias("x1"), y.alias("y1"), (x + 2 + F.pmod(k, F.lit(6))).cast("int").alias("x2"), (y + 2 + F.pmod(k, F.lit(4))).cast("int").alias("y2")]
    return table(spark, d, "part").select(F.floor(k / 5).alias("image"), k.alias("part"), *corners)


PIXELS = """b AS (SELECT p_partkey // 5 AS image, p_partkey AS part, (p_partkey * 7) % 17 AS x1, (p_partkey * 5) % 11 AS y1, (p_partkey * 7) % 17 + 2 + p_partkey % 6 AS x2,
  (p_partkey * 5) % 11 + 2 + p_partkey % 4 AS y2 FROM part),
p AS (SELECT DISTINCT image AS mask_id, y::INT AS y, x::INT AS x FROM b, LATERAL (SELECT unnest(range(y1, y2)) AS y), LATERAL (SELECT unnest(range(x1, x2)) AS x)),
i AS (SELECT DISTINCT mask_id FROM p),
g AS (SELECT mask_id, y::INT AS y, x::INT AS x FROM i, LATERAL (SELECT unnest(range(0, 16)) AS y), LATERAL (SELECT unnest(range(0, 24)) AS x))"""


def _rasters(spark, d):
    return masks.drawn(_boxes(spark, d), "image", F.lit(W), F.lit(H))


@query(f"WITH {PIXELS} SELECT mask_id, y, x, 255 AS v FROM p")
def mask_png(spark, d):
    """Masks written as PNG files, in base64 and back, read and listed again."""
    files = png.written_masks(_rasters(spark, d)).withColumn("content", actions.from_data_url(F.concat(F.lit("data:image/png;base64,"), actions.png_base64(F.col("content")))))
    return masks.pixels_of(png.read_masks(files.withColumnRenamed("mask_id", "file")))


@query(f"WITH {PIXELS} SELECT mask_id, y, x, 255 AS v FROM g ANTI JOIN p USING (mask_id, y, x)")
def mask_inverted(spark, d):
    return masks.pixels_of(masks.inverted(_rasters(spark, d)))


@query(
    f"""WITH {PIXELS}, s AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) t(dy, dx))
SELECT DISTINCT g.mask_id, g.y, g.x, 255 AS v FROM g JOIN s ON true JOIN p ON p.mask_id = g.mask_id AND p.y = g.y + dy AND p.x = g.x + dx"""
)
def mask_dilated(spark, d):
    return masks.pixels_of(masks.per_mask(_rasters(spark, d), lambda m: masks.dilate(m, 3)))


@query(
    f"""WITH {PIXELS}, s AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) t(dy, dx)),
h AS (SELECT p.mask_id, p.y, p.x, count(*) FILTER (WHERE q.y IS NOT NULL OR p.y + dy NOT BETWEEN 0 AND 15 OR p.x + dx NOT BETWEEN 0 AND 23) AS n
  FROM p JOIN s ON true LEFT JOIN p q ON q.mask_id = p.mask_id AND q.y = p.y + dy AND q.x = p.x + dx GROUP BY 1, 2, 3)
SELECT mask_id, y, x, 255 AS v FROM h WHERE n = 5"""
)
def mask_eroded(spark, d):
    return masks.pixels_of(masks.per_mask(_rasters(spark, d), lambda m: masks.erode(m, 3)))


REGIONS = f"""WITH RECURSIVE {PIXELS}, n AS (SELECT mask_id, y, x, y * 24 + x AS id FROM p),
r AS (SELECT mask_id, id, y, x, id AS seen FROM n UNION SELECT r.mask_id, r.id, m.y, m.x, m.id FROM r JOIN n m ON m.mask_id = r.mask_id AND abs(m.y - r.y) <= 1 AND abs(m.x - r.x) <= 1),
l AS (SELECT mask_id, id, min(seen) AS label FROM r GROUP BY 1, 2),
k AS (SELECT mask_id, label, min(n.x) AS x1, min(n.y) AS y1, max(n.x) + 1 AS x2, max(n.y) + 1 AS y2, count(*) AS area FROM l JOIN n USING (mask_id, id) GROUP BY 1, 2)"""


@query(f"{REGIONS} SELECT mask_id, x1, y1, x2, y2, area FROM k WHERE x2 - x1 >= 3 AND y2 - y1 >= 3")
def mask_regions(spark, d):
    return masks.regions(_rasters(spark, d)).drop("region")


@query(
    f"""{REGIONS}, o AS (SELECT mask_id, label FROM k WHERE area >= 8 AND area <= 60 AND x2 - x1 >= 2 AND y2 - y1 >= 3
  AND greatest(x2 - x1, y2 - y1) <= 3 * least(x2 - x1, y2 - y1))
SELECT mask_id, n.y AS y, n.x AS x, 255 AS v FROM o JOIN l USING (mask_id, label) JOIN n USING (mask_id, id)"""
)
def mask_kept_regions(spark, d):
    """Masks without regions of a wrong area, width, height or shape."""
    return masks.pixels_of(masks.per_mask(_rasters(spark, d), lambda m: masks.keep_regions(m, 8, 60, 2, 3, 3)))


CROSS = "(SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) t(dy, dx))"


def _grown(name, kind):
    """SQL for the pixels of ``name`` grown by a cross, in masks of some kinds."""
    return f"SELECT DISTINCT g.mask_id, g.y, g.x FROM g JOIN {CROSS} s ON g.mask_id % 4 IN ({kind}) JOIN {name} q ON q.mask_id = g.mask_id AND q.y = g.y + dy AND q.x = g.x + dx"


def _worn(name, kind):
    """SQL for the pixels of ``name`` whose cross is covered or beyond the edge."""
    return f"""SELECT a.mask_id, a.y, a.x FROM {name} a JOIN {CROSS} s ON a.mask_id % 4 IN ({kind}) LEFT JOIN {name} q ON q.mask_id = a.mask_id AND q.y = a.y + dy AND q.x = a.x + dx
  GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE q.y IS NOT NULL OR a.y + dy NOT BETWEEN 0 AND 15 OR a.x + dx NOT BETWEEN 0 AND 23) = 5"""


@query(
    f"""{REGIONS}, d AS ({_grown("p", "0, 2")}), c AS ({_worn("d", "0")}), e AS ({_worn("p", "1")}), o AS ({_grown("e", "1")}),
f AS (SELECT mask_id, n.y AS y, n.x AS x FROM k JOIN l USING (mask_id, label) JOIN n USING (mask_id, id) WHERE mask_id % 4 = 3 AND area >= 0.02 * 384 AND area <= 0.15 * 384 AND x2 - x1 >= 3 AND y2 - y1 >= 3
  AND greatest(x2 - x1, y2 - y1) <= 2 * least(x2 - x1, y2 - y1))
SELECT mask_id, y, x, 255 AS v FROM c UNION ALL SELECT mask_id, y, x, 255 FROM o UNION ALL SELECT mask_id, y, x, 255 FROM d WHERE mask_id % 4 = 2 UNION ALL SELECT mask_id, y, x, 255 FROM f"""
)
def part_chains(spark, d):
    """Masks of four kinds of parts, each through its own chain: closed, opened, grown, or without regions of a wrong size and shape."""
    n = F.col("n_nationkey")
    at = lambda k, v: F.when(n == k, v)
    steps = table(spark, d, "nation").where("n_nationkey < 4").select(
        n.cast("long").alias("part"), at(0, 3).alias("close"), at(1, 3).alias("open"), at(2, 3).alias("grow"), F.lit(None).alias("blur"),
        at(3, 0.02).alias("min_share"), at(3, 0.15).alias("max_share"), at(3, 3).alias("min_side"), at(3, 2.0).alias("max_aspect"),
    )
    return masks.pixels_of(masks.chained(_rasters(spark, d).withColumn("part", F.col("mask_id") % 4), steps))


@query(
    f"""WITH {PIXELS}, f AS (SELECT DISTINCT p_partkey // 5 AS image FROM part),
a AS (SELECT image, y::INT AS y, x::INT AS x FROM f, LATERAL (SELECT unnest(range(0, 16)) AS y) j, LATERAL (SELECT unnest(range(0, 24)) AS x) k),
m AS (SELECT a.*, p.y IS NOT NULL AS covered FROM a LEFT JOIN p ON p.mask_id = a.image AND p.mask_id % 3 < 2 AND p.y = a.y AND p.x = a.x)
SELECT image, y, x, CASE WHEN covered THEN 1 ELSE ((y * 24 + x) * 3 * 5 + image) % 256 END AS r, CASE WHEN covered THEN 2 ELSE (((y * 24 + x) * 3 + 1) * 5 + image) % 256 END AS g,
  CASE WHEN covered THEN 3 ELSE (((y * 24 + x) * 3 + 2) * 5 + image) % 256 END AS b FROM m"""
)
def painted_pictures(spark, d):
    """Colour pictures with what their masks cover painted over, by way of PNG files; one in three has no mask."""
    k = F.col("image")
    byte = lambda i: F.lpad(F.hex((i * 5 + k) % 256), 2, "0")
    cycle = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), byte), "")  # the bytes come again after 256
    raster = F.unhex(F.substring(F.repeat(cycle, F.lit(W * H * 3 // 256 + 1)), 1, W * H * 3 * 2))
    images = masks.dealt(table(spark, d, "part").select(F.floor(F.col("p_partkey") / 5).alias("image")), "image").distinct().select("image", F.lit(W).alias("width"), F.lit(H).alias("height"), raster.alias("raster"))
    found = masks.painted(images, _rasters(spark, d).where("mask_id % 3 < 2"), (1, 2, 3))
    files = png.written_masks(found.withColumnRenamed("image", "mask_id")).select(F.concat(F.col("mask_id").cast("string"), F.lit(".png")).alias("file"), "content")
    folder = Written(spark, "painted").root
    actions.export_files(files, folder)
    seen = pictures.rasters(pictures.pictures(spark, folder)).withColumn("image", F.regexp_extract("image", "[0-9]+", 0).cast("long"))
    return pictures.colours(seen)


@query(f"WITH {PIXELS} SELECT mask_id, y, x, 255 AS v FROM g WHERE (y * 24 + x) * 7 % 256 > 127")
def mask_from_probabilities(spark, d):
    """Masks of where a segmentation of the image's size exceeds a half."""
    import numpy as np

    ramp = lambda m: masks.from_probabilities((np.arange(m.size).reshape(m.shape) * 7 % 256) / 255.0, m.shape[1], m.shape[0])
    return masks.pixels_of(masks.per_mask(_rasters(spark, d), ramp))


#: Boxes far enough apart to be regions of their own, large enough to have an outline.
APART = """b AS (SELECT p_partkey AS image, (p_partkey * 7) % 5 + k * 40 AS x1, (p_partkey * 5) % 9 AS y1, (p_partkey * 7) % 5 + k * 40 + 10 + p_partkey % 20 AS x2, (p_partkey * 5) % 9 + 9 + p_size % 20 AS y2
  FROM part, LATERAL (SELECT unnest([0, 1]) AS k))"""


def _apart(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select("p_partkey", "p_size", F.explode(F.array(F.lit(0), F.lit(40))).alias("k"))
    x, y = (F.pmod(k * 7, F.lit(5)) + F.col("k")).cast("int"), F.pmod(k * 5, F.lit(9)).cast("int")
    boxed = rows.select(k.alias("mask_id"), x.alias("x1"), y.alias("y1"), (x + 10 + k % 20).cast("int").alias("x2"), (y + 9 + F.col("p_size") % 20).cast("int").alias("y2"))
    return masks.drawn(boxed, "mask_id", F.lit(80), F.lit(40))


@query(
    f"""WITH {APART} SELECT image, 'mask' AS label, x1, y1, x2 - 1 AS x2, y2 - 1 AS y2, 4 AS corners FROM b"""
)
def mask_annotations(spark, d):
    """Masks to annotations: the outlines of their regions, as JSON, with the corners that it names."""
    made = actions.annotation_json(masks.outlines(_apart(spark, d)))
    shapes = made.select("image", F.explode(F.from_json("json", sources.ANNOTATION)["shapes"]).alias("s"))
    of = lambda pick, i: pick(F.transform("s.points", lambda p: p[i])).cast("int")
    return shapes.select(
        "image", "s.label", of(F.array_min, 0).alias("x1"), of(F.array_min, 1).alias("y1"), of(F.array_max, 0).alias("x2"), of(F.array_max, 1).alias("y2"), F.size("s.points").alias("corners")
    )


@query(f"""WITH {APART} SELECT image AS mask_id, sum((x2 - x1) * (y2 - y1))::BIGINT AS pixels FROM b GROUP BY 1""")
def annotation_masks(spark, d):
    """Annotations to masks: polygons drawn, one mask an image."""
    drawn = masks.filled(masks.outlines(_apart(spark, d)))
    return masks.covered_share(drawn).select("mask_id", F.col("mask_pixels").alias("pixels"))


#: SQL for the pixels of polygons ``e`` (image, i, xa, ya, xb, yb: an edge each) on a grid of 40 x 32: between each
#: odd crossing of a line and the next, or within half a pixel of an edge.
FILLED = """k AS (SELECT image, y, xa + (y - ya) * (xb - xa)::DOUBLE / (yb - ya) AS c FROM e, LATERAL (SELECT unnest(range(0, 32)) AS y) WHERE ya <= y AND y < yb OR yb <= y AND y < ya),
o AS (SELECT image, y, c, lead(c) OVER (PARTITION BY image, y ORDER BY c) AS z, row_number() OVER (PARTITION BY image, y ORDER BY c) AS n FROM k),
t AS (SELECT e.image, y, x, CASE WHEN xa = xb AND ya = yb THEN 0 ELSE least(1, greatest(0, ((x - xa) * (xb - xa) + (y - ya) * (yb - ya))::DOUBLE / ((xb - xa) * (xb - xa) + (yb - ya) * (yb - ya)))) END AS t, xa, ya, xb, yb
  FROM e, LATERAL (SELECT unnest(range(0, 32)) AS y), LATERAL (SELECT unnest(range(0, 40)) AS x)),
f AS (SELECT image, y::INT AS y, x::INT AS x FROM o, LATERAL (SELECT unnest(range(greatest(0, ceil(c)::INT), least(40, floor(z)::INT + 1))) AS x) WHERE n % 2 = 1
  UNION SELECT image, y, x FROM t WHERE (x - xa - t * (xb - xa)) * (x - xa - t * (xb - xa)) + (y - ya - t * (yb - ya)) * (y - ya - t * (yb - ya)) <= 0.25)"""
CORNERS = """c AS (SELECT s_suppkey AS image, list_value(list_value(s_suppkey * 7 % 40, s_suppkey * 5 % 30), list_value((s_suppkey * 11 + 13) % 40, (s_suppkey * 3 + 7) % 30), list_value((s_suppkey * 17 + 5) % 40, (s_suppkey * 13 + 11) % 30),
  list_value((s_suppkey * 19 + 23) % 40, (s_suppkey * 29 + 3) % 30)) AS p FROM supplier),
e AS (SELECT image, p[i][1] AS xa, p[i][2] AS ya, p[i % 4 + 1][1] AS xb, p[i % 4 + 1][2] AS yb FROM c, LATERAL (SELECT unnest(range(1, 5)) AS i))"""
TRIANGLES = """c AS (SELECT s_suppkey AS image, list_value(list_value(s_suppkey % 10, s_suppkey % 7), list_value(25 + s_suppkey % 13, s_suppkey * 3 % 9), list_value(s_suppkey * 7 % 30, 15 + s_suppkey % 14)) AS p FROM supplier),
e AS (SELECT image, p[i][1] AS xa, p[i][2] AS ya, p[i % 3 + 1][1] AS xb, p[i % 3 + 1][2] AS yb FROM c, LATERAL (SELECT unnest(range(1, 4)) AS i))"""


def _polygons(spark, d, corners):
    """One polygon a supplier on a grid of 40 x 32."""
    k = F.col("s_suppkey")
    points = F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in corners(k)])
    return table(spark, d, "supplier").select(k.alias("image"), F.lit(40).alias("width"), F.lit(32).alias("height"), points.alias("points"))


@query(f"WITH {CORNERS}, {FILLED} SELECT image AS mask_id, y, x, 255 AS v FROM f")
def polygon_fills(spark, d):
    """Polygons of four corners anywhere, many of them crossing themselves, as masks."""
    corners = lambda k: [(k * 7 % 40, k * 5 % 30), ((k * 11 + 13) % 40, (k * 3 + 7) % 30), ((k * 17 + 5) % 40, (k * 13 + 11) % 30), ((k * 19 + 23) % 40, (k * 29 + 3) % 30)]
    return masks.pixels_of(masks.filled(_polygons(spark, d, corners)))


@query(f"WITH {TRIANGLES}, {FILLED} SELECT image AS mask_id, y, x, 255 AS v FROM f")
def polygon_outlines(spark, d):
    """Triangles as masks, their whole outlines, and the masks that these make again."""
    corners = lambda k: [(k % 10, k % 7), (25 + k % 13, k * 3 % 9), (k * 7 % 30, 15 + k % 14)]
    drawn = masks.filled(_polygons(spark, d, corners))
    return masks.pixels_of(masks.filled(masks.outlines(drawn, min_area=0, tolerance=0.0)))


@query(
    f"""WITH {PIXELS}, w AS (SELECT d, exp(-d * d / 1.28) / (1 + 2 * exp(-1 / 1.28)) AS w FROM (VALUES (-1), (0), (1)) t(d)),
n AS (SELECT g.mask_id, g.y, g.x, sum(a.w * b.w * CASE WHEN p.y IS NULL THEN 0 ELSE 255 END) AS v FROM g JOIN w a ON true JOIN w b ON true
  LEFT JOIN p ON p.mask_id = g.mask_id AND p.y = CASE WHEN g.y + a.d < 0 THEN 1 WHEN g.y + a.d > 15 THEN 14 ELSE g.y + a.d END AND p.x = CASE WHEN g.x + b.d < 0 THEN 1 WHEN g.x + b.d > 23 THEN 22 ELSE g.x + b.d END GROUP BY 1, 2, 3)
SELECT mask_id, y, x, 255 AS v FROM n WHERE v > 127"""
)
def mask_smoothed(spark, d):
    """Masks blurred by three pixels and cut at half."""
    return masks.pixels_of(masks.per_mask(_rasters(spark, d), lambda m: masks.smooth(m, 3)))


def _part_rasters(spark, d):
    """A mask a part, every other one at half the size."""
    size = F.when(F.col("part") % 2 == 0, 2).otherwise(1)
    low, high = (lambda c: F.floor(F.col(c) / size).cast("int")), (lambda c: F.ceil(F.col(c) / size).cast("int"))
    small = _boxes(spark, d).select("part", low("x1").alias("x1"), low("y1").alias("y1"), high("x2").alias("x2"), high("y2").alias("y2"))
    return masks.drawn(small, "part", (F.lit(W) / size).cast("int"), (F.lit(H) / size).cast("int"))


MERGED = f"""{PIXELS}, q AS (SELECT image, part, part % 2 = 0 AS small, x, y FROM b, LATERAL (SELECT unnest(range(y1, y2)) AS y), LATERAL (SELECT unnest(range(x1, x2)) AS x) WHERE y < 16 AND x < 24),
f AS (SELECT image, min(part) AS first FROM q WHERE {{0}} GROUP BY image),
h AS (SELECT DISTINCT image, CASE WHEN small THEN 2 ELSE 1 END AS s, part, y // CASE WHEN small THEN 2 ELSE 1 END AS y, x // CASE WHEN small THEN 2 ELSE 1 END AS x FROM q WHERE {{0}}),
t AS (SELECT image, CASE WHEN first % 2 = 0 THEN 2 ELSE 1 END AS s FROM f),
z AS (SELECT image, t.s, y::INT AS y, x::INT AS x FROM t, LATERAL (SELECT unnest(range(0, 16 // t.s)) AS y), LATERAL (SELECT unnest(range(0, 24 // t.s)) AS x)),
u AS (SELECT DISTINCT z.image AS mask_id, z.y, z.x FROM z JOIN h ON h.image = z.image AND h.y = z.y * z.s // h.s AND h.x = z.x * z.s // h.s)"""


@query(f"WITH {MERGED.format('true')} SELECT image AS mask_id, z.y, z.x, 255 AS v FROM z ANTI JOIN u ON u.mask_id = z.image AND u.y = z.y AND u.x = z.x")
def merge_files(spark, d):
    """The mask files of an image joined at the size of the first, and inverted."""
    of = _boxes(spark, d).select("image", F.col("part").alias("mask_id"))
    rows = _part_rasters(spark, d).join(of, "mask_id").select("image", F.col("mask_id").alias("place"), "width", "height", "raster")
    return masks.pixels_of(masks.merged_files(rows, invert_=True))


@query(
    f"""WITH {MERGED.format('true')}, e AS (SELECT image, count(*) AS n FROM z ANTI JOIN u ON u.mask_id = z.image AND u.y = z.y AND u.x = z.x GROUP BY 1)
SELECT t.image AS mask_id, coalesce(e.n, 0) AS mask_pixels, round_even(coalesce(e.n, 0) * 100 / ((16 // t.s) * (24 // t.s)), 4) AS mask_ratio_percent FROM t LEFT JOIN e USING (image)"""
)
def merge_common(spark, d):
    """What all mask files of an image, here of all but a part, have in common, with its share."""
    of = _boxes(spark, d).select("image", F.col("part").alias("mask_id"))
    rows = masks.inverted(_part_rasters(spark, d)).join(of, "mask_id").select("image", F.col("mask_id").alias("place"), "width", "height", "raster")
    return masks.covered_share(masks.merged_files(rows, operation="intersection"))


@query(f"WITH {MERGED.format('part % 3 = 0')} SELECT mask_id, y, x, 255 AS v FROM u")
def render_report(spark, d):
    """One mask an image from the parts of its report that were asked for."""
    rows = _boxes(spark, d).select("image", "part", (F.col("part") % 3 == 0).alias("has_detection"), F.col("part").alias("mask_file"))
    return masks.pixels_of(masks.rendered(sources.render_parts(rows), _part_rasters(spark, d)))


@query(
    f"""WITH {PIXELS}, a AS (SELECT part, count(*) AS n FROM b GROUP BY 1),
q AS (SELECT image, x1 - 3 AS x1, y1 - 2 AS y1, x2 + 5 AS x2, y2 + 1 AS y2, part % 5 AS person_id FROM b WHERE part % 2 = 0),
m AS (SELECT b.image, b.part, q.person_id, (b.x2 - b.x1) * (b.y2 - b.y1) AS n, greatest(0, least(b.x2, q.x2) - greatest(b.x1, q.x1)) * greatest(0, least(b.y2, q.y2) - greatest(b.y1, q.y1)) AS i,
  (q.x2 - q.x1) * (q.y2 - q.y1) AS w, sqrt(((b.x1 + b.x2 - 1) / 2 - (q.x1 + q.x2) / 2) ** 2 + ((b.y1 + b.y2 - 1) / 2 - (q.y1 + q.y2) / 2) ** 2) / sqrt((q.x2 - q.x1) ** 2 + (q.y2 - q.y1) ** 2) AS far
  FROM b JOIN q ON q.image = b.image)
SELECT image, part, person_id, round(0.4::DOUBLE * i / (n + w - i) + 0.3::DOUBLE * greatest(0, 1 - far) + 0.3::DOUBLE * i / n, 6) AS score FROM m"""
)
def mask_scores(spark, d):
    """How well the masks of parts fit the boxes of persons."""
    b = _boxes(spark, d)
    wide = geometry.box(F.col("x1") - 3, F.col("y1") - 2, F.col("x2") + 5, F.col("y2") + 1)
    people = b.where("part % 2 = 0").select("image", (F.col("part") % 5).alias("person_id"), wide.alias("bbox"))
    return runs.matches(runs.of_boxes(b, ["image", "part"]), people).select("image", "part", "person_id", F.round("score", 6).alias("score"))


@query(
    """SELECT vec_id, (i - 1)::INT AS i, round(least(1, greatest(0, embedding[i]::DOUBLE + embedding[i + 1]::DOUBLE - embedding[i + 2]::DOUBLE)), 6) AS v,
  round(least(1, greatest(0, embedding[i]::DOUBLE - embedding[i + 1]::DOUBLE + embedding[i + 2]::DOUBLE)), 6) AS w
FROM embeddings, LATERAL (SELECT unnest(range(1, 63)) AS i)"""
)
def soft_layers(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(61))).alias("i"))
    a, m, i = (F.get("embedding", F.col("i") + k).cast("double") for k in range(3))
    return rows.select("vec_id", "i", F.round(masks.soft_merge(a, m, i), 6).alias("v"), F.round(masks.soft_merge(a, m, i, True), 6).alias("w"))


@query(
    f"""WITH {PIXELS}, e AS (SELECT mask_id, y, x FROM p WHERE (x + y) % 3 > 0)
SELECT mask_id AS image, y, x, 'intersection' AS operation FROM e UNION ALL SELECT mask_id, y, x, 'union' FROM p UNION ALL SELECT mask_id, y, x, 'mask_only' FROM e"""
)
def mask_combinations(spark, d):
    """A drawn mask with an existing one: what both have, what either has, the existing one."""
    drawn = runs.of_boxes(_boxes(spark, d), ["image"])
    existing = runs.pixels(drawn, ["image"]).where("(x + y) % 3 > 0").select("image", "y", F.col("x").alias("x1"), (F.col("x") + 1).alias("x2"))
    out = None
    for operation in ("intersection", "union", "mask_only"):
        found = runs.pixels(runs.combine(drawn, existing, operation), ["image"])
        one = found.select("image", "y", "x", F.lit(operation).alias("operation"))
        out = one if out is None else out.unionByName(one)
    return out


PROMPTS = """b AS (SELECT p_partkey // 5 AS image, p_partkey AS part, p_partkey % 3 = 0 AS negative, (p_partkey * 7) % 17 AS x1, (p_partkey * 5) % 11 AS y1, (p_partkey * 7) % 17 + 2 + p_partkey % 6 AS x2,
  (p_partkey * 5) % 11 + 2 + p_partkey % 4 AS y2 FROM part),
p AS (SELECT DISTINCT image, negative, y::INT AS y, x::INT AS x FROM b, LATERAL (SELECT unnest(range(y1, y2)) AS y), LATERAL (SELECT unnest(range(x1, x2)) AS x))"""


@query(
    f"""WITH {PROMPTS}, n AS (SELECT image, y, x FROM p WHERE negative), a AS (SELECT image, y, x FROM p WHERE NOT negative)
SELECT 'both' AS mode, image, y, x FROM a ANTI JOIN n USING (image, y, x) UNION ALL SELECT 'positive', image, y, x FROM a UNION ALL SELECT 'negative', image, y, x FROM n"""
)
def run_prompts(spark, d):
    """Masks of positive prompts without the negative ones, and of either side, as runs."""
    b = _boxes(spark, d)
    sides = [runs.of_boxes(b.where(w), ["image"]) for w in ("part % 3 > 0", "part % 3 = 0")]
    out = None
    for mode in ("both", "positive", "negative"):
        one = runs.pixels(runs.prompted(*sides, mode), ["image"]).select(F.lit(mode).alias("mode"), "image", "y", "x")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    f"""WITH {PROMPTS}, g AS (SELECT image, i.y::INT AS y, j.x::INT AS x FROM (SELECT DISTINCT image FROM p) k, LATERAL (SELECT unnest(range(0, 16)) AS y) i, LATERAL (SELECT unnest(range(0, 24)) AS x) j)
SELECT image, count(*) AS pixels FROM (SELECT image, y, x FROM g ANTI JOIN p USING (image, y, x)) GROUP BY 1"""
)
def run_inverted(spark, d):
    """Pixels of each image that its masks leave free, from rasters by way of runs."""
    b = _boxes(spark, d)
    found = runs.of_rasters(runs.rasterized(runs.of_boxes(b, ["image"]), "image", F.lit(W), F.lit(H))).withColumnRenamed("mask_id", "image")
    sizes = b.select("image").distinct().select("image", F.lit(W).alias("width"), F.lit(H).alias("height"))
    return runs.areas(runs.inverted(found, sizes, ["image"]), ["image"])


@query(
    """WITH v AS (SELECT p_partkey, list_transform(range(0, 72), lambda i: (p_partkey * (i + 3) * 7 + i * i) % 256) AS v FROM part),
b AS (SELECT p_partkey, list_transform(list_filter(range(0, 72), lambda i: i % 9 <> 8), lambda i: CASE WHEN v[i + 1] > v[i + 2] THEN 1 ELSE 0 END) AS b FROM v),
h AS (SELECT p_partkey, list_reduce(list_prepend(0::HUGEINT, list_transform(b, lambda x: x::HUGEINT)), lambda a, x: a * 2 + x) AS h FROM b)
SELECT p_partkey AS file, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS hash FROM h"""
)
def image_hashes(spark, d):
    """Difference hashes of pictures of 9 x 8 pixels, from their PNG files."""
    k = F.col("p_partkey")
    value = lambda i: F.lpad(F.hex((k * (i + 3) * 7 + i * i) % 256), 2, "0")
    raster = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(71)), value), ""))
    rows = table(spark, d, "part").select(k.alias("mask_id"), F.lit(9).alias("width"), F.lit(8).alias("height"), raster.alias("raster"))
    files = png.written_masks(rows).withColumnRenamed("mask_id", "file")
    return png.grey_values(files).select("file", neighbors.difference_hash(F.col("values"), row=9).alias("hash"))


@query(
    """WITH v AS (SELECT s_suppkey, list_transform(range(0, 72), lambda i: (s_suppkey * (i + 3) * 7 + i * i) % 13 * 18 + i % 2 * 9) AS v FROM supplier),
b AS (SELECT s_suppkey, list_transform(list_filter(range(0, 72), lambda i: i % 9 <> 8), lambda i: CASE WHEN v[i + 1] > v[i + 2] THEN 1 ELSE 0 END) AS b FROM v),
h AS (SELECT s_suppkey, list_reduce(list_prepend(0::HUGEINT, list_transform(b, lambda x: x::HUGEINT)), lambda a, x: a * 2 + x) AS h FROM b)
SELECT s_suppkey || '.jpg' AS file, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::VARCHAR AS hash, NULL::VARCHAR AS error FROM h
UNION ALL SELECT s_suppkey || 'b.jpeg', NULL, 'not a picture' FROM supplier WHERE s_nationkey % 5 = 0"""
)
def jpeg_hashes(spark, d):
    """Difference hashes of JPEG files of many sizes, from cells of equal pixels; some files are broken."""
    k = F.col("s_suppkey")
    value = lambda i: F.lpad(F.hex((k * (i + 3) * 7 + i * i) % 13 * 18 + i % 2 * 9), 2, "0")
    wide, high = (3 + k % 6).cast("int"), (3 + k % 4).cast("int")
    line = lambda y: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda x: F.repeat(value(9 * y + x), wide)), "")
    raster = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.repeat(line(y), high)), ""))
    rows = table(spark, d, "supplier").select(k.alias("mask_id"), (9 * wide).alias("width"), (8 * high).alias("height"), raster.alias("raster"), "s_nationkey")
    made = jpeg.written_jpegs(rows).select(F.concat("mask_id", F.lit(".jpg")).alias("file"), "content")
    broken = rows.where("s_nationkey % 5 = 0").select(F.concat("mask_id", F.lit("b.jpeg")).alias("file"), F.unhex(F.lit("FFD8FF00")).alias("content"))
    folder = Written(spark, "pictures").root
    actions.export_files(made.unionByName(broken), folder)
    values = pictures.grey_values(pictures.pictures(spark, folder))
    return values.select("file", neighbors.difference_hash(F.col("values"), row=9).cast("string").alias("hash"), "error")


def _tagger():
    """Stands for a model: one logit an index from the bytes of a file, which name its key."""
    import pandas as pd

    def tag(batch):
        rows = [(i, j, ((int(c) * (j + 3) * 31) % 97 - 48) / 8.0) for i, c in zip(batch["image"], batch["content"], strict=True) for j in range(6)]
        return pd.DataFrame(rows, columns=["image", "idx", "logit"])

    return tag


@query(
    """WITH s AS (SELECT p_partkey AS image, j::INT AS idx, 'tag' || j AS tag, CASE WHEN j < 4 THEN 'general' ELSE 'character' END AS category,
  1 / (1 + exp(-((p_partkey * (j + 3) * 31) % 97 - 48) / 8.0::DOUBLE)) AS p FROM part, LATERAL (SELECT unnest(range(0, 6)) AS j))
SELECT image, idx, tag, category, round(p, 6) AS probability FROM s WHERE p >= CASE WHEN category = 'character' THEN 0.85 ELSE 0.35 END"""
)
def model_tags(spark, d):
    """Tags of a stub model behind the inference boundary, with a vocabulary and thresholds by category."""
    files = table(spark, d, "part").select(F.col("p_partkey").alias("image"), F.col("p_partkey").cast("string").cast("binary").alias("content"))
    logits = boxes.with_model(files, _tagger, "image bigint, idx int, logit double")
    idx = F.col("id").cast("int")
    words = spark.range(6).select(idx.alias("idx"), F.concat(F.lit("tag"), idx).alias("tag"), F.when(idx < 4, "general").otherwise("character").alias("category"))
    return scores.above(scores.named(logits, words), 0.35, 0.85).select("image", "idx", "tag", "category", F.round("probability", 6).alias("probability"))
