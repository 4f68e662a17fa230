"""Queries of the sources and sinks: small tables written as files to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actions, exports, pairing, settings
from ..operators.written import Written
from ..sources import files as sources
from ..sources import options, pictures, png
from ..sources.tables import table
from .registry import query


def _folder(spark: SparkSession, rows: DataFrame) -> str:
    """A new shared folder with the files (file, content)."""
    folder = Written(spark, "files").root
    actions.export_files(rows, folder)
    return folder


def _text_file(spark: SparkSession, name: str, made: DataFrame) -> str:
    return _folder(spark, made.select(F.lit(name).alias("file"), F.col(made.columns[0]).cast("binary").alias("content")))


@query("""SELECT n_name AS stem, n_name || ' é' AS text, NULL::VARCHAR AS error FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT n_name, NULL, 'not UTF-8' FROM nation WHERE n_nationkey = 3""")
def files_captions(spark, d):
    """Captions exported as one file each and read, one of them not UTF-8."""
    body = F.concat("n_name", F.lit(" é"))
    content = F.when(F.col("n_nationkey") == 3, F.unhex(F.lit("FF41"))).otherwise(F.encode(body, "UTF-8"))
    folder = _folder(spark, table(spark, d, "nation").select(F.concat("n_name", F.lit(".txt")).alias("file"), content.alias("content")))
    return sources.captions(spark, folder, lenient=False).select("stem", "text", "error")


IMAGES = "SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN '.png' ELSE '.PNG' END AS image, (n_nationkey + 3)::BIGINT AS width, (n_regionkey + 2)::BIGINT AS height FROM nation"


def _pictures(spark, d):
    """A PNG of its own size for each nation, a broken one and another kind of file."""
    size = table(spark, d, "nation").select(
        F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, ".png").otherwise(".PNG")).alias("mask_id"),
        (F.col("n_nationkey") + 3).cast("int").alias("width"),
        (F.col("n_regionkey") + 2).cast("int").alias("height"),
    )
    blank = size.withColumn("raster", F.unhex(F.repeat(F.lit("7F"), F.col("width") * F.col("height"))))
    made = png.written_masks(blank).withColumnRenamed("mask_id", "file")
    odd = spark.createDataFrame([("broken.png", bytearray(b"no")), ("notes.md", bytearray(b"x"))], "file string, content binary")
    return _folder(spark, made.unionByName(odd))


@query(
    f"""WITH i AS ({IMAGES} UNION ALL SELECT 'broken.png', 0, 0), k AS (SELECT image, regexp_extract(image, '^(.*)[.]', 1) AS stem, CASE WHEN image = 'broken.png' THEN -1 ELSE regexp_extract(image, '[0-9]+')::INT END AS n FROM i)
SELECT image AS file, row_number() OVER (ORDER BY n) AS place FROM k"""
)
def files_in_order(spark, d):
    """A folder's images in natural order."""
    return pairing.in_order(sources.images(spark, _pictures(spark, d))).select("file", "place")


@query(f"""{IMAGES} UNION ALL SELECT 'broken.png', NULL, NULL""")
def files_images(spark, d):
    """A folder's images with the sizes in their headers."""
    return sources.with_size(sources.image_contents(spark, _pictures(spark, d))).select("image", "width", "height")


@query(
    f"""WITH i AS ({IMAGES} UNION ALL SELECT 'broken.png', 0, 0) SELECT image AS file, true AS readable FROM i
UNION ALL SELECT 'up.webp', true UNION ALL SELECT 'up.tiff', false"""
)
def files_mixed(spark, d):
    """A folder's images, then uploads of a supported and of another kind."""
    folder = sources.images(spark, _pictures(spark, d))
    uploads = spark.createDataFrame([("up.webp", "/up/1"), ("up.tiff", "/up/2")], "file string, path string")
    return sources.mixed(folder, uploads).select("file", F.col("path").isNotNull().alias("readable"))


@query(
    """SELECT layout, n_nationkey AS idx, n_name AS tag, CASE WHEN n_nationkey % 2 = 0 THEN 'character' ELSE 'general' END AS category
FROM nation, LATERAL (SELECT unnest(['maps', 'nested', 'records']) AS layout)"""
)
def files_vocabularies(spark, d):
    """A vocabulary in its three layouts."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("tag"), F.when(F.col("n_nationkey") % 2 == 0, "Character").alias("kind"))
    entries = lambda key, value, rows=n: rows.agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias("m"))
    names, kinds = entries("k", "tag"), entries("tag", "kind", n.where("kind IS NOT NULL"))
    both = names.select(F.col("m").alias("idx_to_tag")).crossJoin(kinds.select(F.col("m").alias("tag_to_category")))  # one row each
    records = entries("k", F.struct("tag", F.col("kind").alias("category")))
    files = {
        "maps": both.select(F.to_json(F.struct("idx_to_tag", "tag_to_category"))),
        "nested": both.select(F.to_json(F.struct(F.struct(F.struct("idx_to_tag", "tag_to_category").alias("tag_mapping")).alias("dataset_info")))),
        "records": records.select(F.to_json("m")),
    }
    out = None
    for layout, made in files.items():
        one = sources.vocabulary(spark, _text_file(spark, "vocabulary.json", made)).withColumn("layout", F.lit(layout))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT (row_number() OVER (ORDER BY n_name) - 1)::INT AS idx, n_name AS tag FROM nation""")
def files_classes(spark, d):
    made = table(spark, d, "nation").agg(F.to_json(F.sort_array(F.collect_list("n_name"))).alias("j"))
    return sources.class_list(spark, _text_file(spark, "classes.json", made))


@query("""SELECT r_name AS tag, max(n_name) || ' first' AS alias FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def files_dictionary(spark, d):
    """A dictionary of aliases in CSV, quoted ones with commas, the last row of a tag counting."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat("r_name", F.lit(',"'), "n_name", F.lit(' first, second"'))
    lines = n.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_name", line.alias("line")))), lambda x: x["line"]), "\n").alias("all"))
    return sources.dictionary(spark, _text_file(spark, "tags.csv", lines.select(F.concat(F.lit("tag,alias\n"), "all", F.lit("\n")))))


@query(
    """SELECT n_regionkey || '.json' AS file, list_sort(list_distinct(list('l' || n_nationkey % 3))) AS labels, count(*) AS shapes, (count(*) * 4)::BIGINT AS points FROM nation GROUP BY n_regionkey"""
)
def files_annotations(spark, d):
    """Annotation files written and read, folded by file."""
    k = F.col("n_nationkey").cast("double")
    corner = lambda x, y: F.array(x, y)
    points = F.array(corner(k, k), corner(k + 5, k), corner(k + 5, k + 4), corner(k, k + 4))
    shapes = table(spark, d, "nation").select(
        F.col("n_regionkey").alias("image"), F.lit(100).alias("width"), F.lit(80).alias("height"), F.concat(F.lit("l"), F.col("n_nationkey") % 3).alias("label"), points.alias("points")
    )
    made = actions.annotation_json(shapes).select(F.concat(F.col("image").cast("string"), F.lit(".json")).alias("file"), F.col("json").cast("binary").alias("content"))
    return sources.annotation_summary(sources.annotations(spark, _folder(spark, made)))


@query(
    """SELECT n_regionkey::VARCHAR AS image, 100 AS width, 80 AS height, n_name AS part, n_nationkey::INT AS count, n_nationkey % 2 = 0 AS has_detection, (n_nationkey * 11)::BIGINT AS mask_pixels FROM nation"""
)
def files_reports(spark, d):
    """Mask reports written and read, one row a part."""
    k = F.col("n_nationkey")
    parts = table(spark, d, "nation").select(
        F.col("n_regionkey").cast("string").alias("image"), F.lit(100).alias("width"), F.lit(80).alias("height"), F.col("n_name").alias("part"),
        k.cast("int").alias("count"), (k / 100).alias("confidence"), (k % 2 == 0).alias("has_detection"), (k * 11).alias("mask_pixels"), F.concat("n_name", F.lit(".png")).alias("mask_file"),
    )
    made = actions.report_json(parts).select(F.concat("image", F.lit(".json")).alias("file"), F.col("json").cast("binary").alias("content"))
    return sources.mask_reports(spark, _folder(spark, made)).select("image", "width", "height", "part", "count", "has_detection", "mask_pixels")


def _options(spark, d, line):
    """An options file of one line a nation."""
    n = table(spark, d, "nation").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))).alias("all"))
    return n.select(F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("body"))


@query(
    """SELECT 'parts.n' || n_nationkey || '.name' AS name, n_name AS value FROM nation UNION ALL SELECT 'parts.n' || n_nationkey || '.note', CASE WHEN n_nationkey % 3 > 0 THEN n_name || ': # ' || n_regionkey END FROM nation
UNION ALL SELECT 'parts.n' || n_nationkey || '.list.' || i, (n_nationkey + i)::VARCHAR FROM nation, LATERAL (SELECT unnest(range(0, 1 + n_regionkey)) AS i)"""
)
def files_options(spark, d):
    """Nested options with comments, quotes, lists and names without a value."""
    k = F.col("n_nationkey")
    items = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_regionkey").cast("int")), lambda i: F.concat(F.lit("\n  - "), (k + i).cast("string"))), "")
    note = F.when(k % 3 > 0, F.concat(F.lit('"'), "n_name", F.lit(": # "), "n_regionkey", F.lit('" # said'))).otherwise("")
    line = F.concat(F.lit(" n"), k, F.lit(":\n  name: "), "n_name", F.lit(" # the name\n  note: "), note, F.lit("\n  list:"), items)
    return options.options(spark, _text_file(spark, "options.yaml", _options(spark, d, line).select(F.concat(F.lit("# settings\nparts:\n"), "body"))))


@query(
    """WITH f AS (SELECT n_name AS part, 'kind' || n_regionkey AS type, n_nationkey % 2 = 0 AS enabled, (n_nationkey + 1) / 100::DOUBLE AS conf, CASE WHEN n_nationkey % 4 = 1 THEN true WHEN n_nationkey % 4 = 2 THEN false END AS fe,
  CASE WHEN n_nationkey % 5 = 0 THEN 0.5::DOUBLE END AS fc FROM nation),
q AS (SELECT c_custkey AS request, c_custkey % 3 AS m, c_nationkey AS a, (c_custkey % 25) AS b FROM customer),
r AS (SELECT q.*, (SELECT n_name FROM nation WHERE n_nationkey = q.a) AS one, (SELECT n_name FROM nation WHERE n_nationkey = q.b) AS two FROM q)
SELECT request, part, type, CASE WHEN m > 0 THEN part = one OR part = two ELSE coalesce(fe, enabled) END AS enabled, CASE WHEN m < 2 AND part = two THEN 0.9::DOUBLE ELSE coalesce(fc, conf) END AS conf,
  CASE WHEN m > 0 THEN 'request' WHEN fe IS NOT NULL THEN 'file' ELSE 'default' END AS enabled_by, CASE WHEN m < 2 AND part = two THEN 'request' WHEN fc IS NOT NULL THEN 'file' ELSE 'default' END AS conf_by
FROM r, f"""
)
def part_settings(spark, d):
    """Every part as every customer's request, an options file and the registry say."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    registry = n.select(F.col("n_name").alias("part"), F.concat(F.lit("kind"), "n_regionkey").alias("type"), (k % 2 == 0).alias("enabled"), ((k + 1) / 100).alias("conf"))
    switch = F.when(k % 4 == 1, "yes").when(k % 4 == 2, "no").otherwise("")
    lines = lambda name, value: F.concat(F.lit(" "), F.lit('"'), "n_name", F.lit('": '), value)
    body = _options(spark, d, lines("s", switch)).select(F.concat(F.lit("enabled_parts:\n"), "body").alias("a"))
    sure = _options(spark, d, lines("c", F.when(k % 5 == 0, "0.5").when(k % 5 == 1, "high").otherwise("~"))).select(F.concat(F.lit("\nconfidence:\n"), "body").alias("b"))
    said = options.options(spark, _text_file(spark, "parts.yaml", body.crossJoin(sure).select(F.concat("a", "b"))))  # one row each
    c = table(spark, d, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("one")), "c_nationkey")
    c = c.join(n.select(F.col("n_nationkey").alias("_b"), F.col("n_name").alias("two")), F.col("c_custkey") % 25 == F.col("_b"))
    asked = c.select(
        F.col("c_custkey").alias("request"),
        F.when(F.col("c_custkey") % 3 > 0, F.array("one", F.concat(F.lit("old "), "two"), F.lit("unknown"))).alias("parts"),
        F.when(F.col("c_custkey") % 3 < 2, F.create_map("two", F.lit(0.9))).alias("confidence"),
    )
    names = [r["n_name"] for r in n.select("n_name").collect()]  # 25, a fixed table
    return settings.part_settings(asked, said, registry, {f"old {name}": name for name in names})


def _captioned(spark, d):
    """A folder of a caption and a picture a supplier, some without a picture: both sides, tags, a sentence, nothing."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier")
    text = F.when(k % 4 == 0, F.concat(F.lit("tag "), k, F.lit(", long hair, A cat is sitting here on the mat."))).when(k % 4 == 1, F.concat(F.lit("tag "), k, F.lit(", long hair"))).when(k % 4 == 2, "caption: A cat is sitting here on the mat.").otherwise("")
    texts = s.select(F.concat(k.cast("string"), F.lit(".txt")).alias("file"), F.encode(text, "UTF-8").alias("content"))
    blank = s.where("s_suppkey % 5 > 0").select(k.alias("mask_id"), F.lit(3).alias("width"), F.lit(2).alias("height"), F.unhex(F.repeat(F.lpad(F.hex(k % 256), 2, "0"), 6)).alias("raster"))
    pictures = png.written_masks(blank).select(F.concat(F.col("mask_id").cast("string"), F.lit(".png")).alias("file"), "content")
    return _folder(spark, texts.unionByName(pictures))


@query(
    """WITH s AS (SELECT s_suppkey AS k, s_suppkey % 4 AS m, s_suppkey % 5 > 0 AS seen FROM supplier), t AS (SELECT k, 'tag ' || k || ', long hair' AS tags FROM s),
e AS (SELECT 'tag' AS target, k, seen, tags AS body FROM s JOIN t USING (k) WHERE m < 2 UNION ALL SELECT 'caption', k, seen, 'A cat is sitting here on the mat.' FROM s WHERE m IN (0, 2))
SELECT target, k || '.txt' AS file, body, 'kept' AS again FROM e UNION ALL SELECT target, k || '.png', (k % 256)::VARCHAR, 'kept' FROM e WHERE seen
UNION ALL SELECT 'source', k || '.txt', CASE m WHEN 0 THEN tags WHEN 1 THEN tags WHEN 2 THEN 'caption: A cat is sitting here on the mat.' ELSE '' END, CASE WHEN m = 0 THEN 'kept' END FROM s JOIN t USING (k)"""
)
def split_folders(spark, d):
    """A folder split into two, its captions rewritten to their tags, and all done once more; files as they are then."""
    source = _captioned(spark, d)
    folders = {"tag": f"{source}-tag", "caption": f"{source}-caption"}
    written = Written(spark, "split")
    plan = written.save(exports.split_plan(spark, source), "plan")
    exports.carry_out(spark, plan, folders, f"{written.root}/first")
    again = exports.carry_out(spark, plan, folders, f"{written.root}/again").select("target", "file", F.col("state").alias("again"))
    review = written.save(exports.rewrites(spark, source), "review")
    written.save(exports.rewrite(review, source), "rewritten")
    twice = written.save(exports.rewrite(review, source), "rewritten-again").select(F.lit("source").alias("target"), "file", F.col("state").alias("again"))
    out = None
    for target, folder in {**folders, "source": source}.items():
        texts = sources.captions(spark, folder).select(F.lit(target).alias("target"), "file", F.col("text").alias("body"))
        out = texts if out is None else out.unionByName(texts)
        if target != "source":
            seen = pictures.pictures(spark, folder).select(F.lit(target).alias("target"), "file", F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).alias("body"))
            out = out.unionByName(seen)
    return out.join(again.unionByName(twice), ["target", "file"], "left")


@query("""SELECT 'c' || s_suppkey || '.txt' AS file, CASE WHEN s_suppkey % 2 = 0 THEN 'new ' || s_name ELSE 'old ' || s_name END AS text FROM supplier""")
def files_overwritten(spark, d):
    """Captions exported to a folder, and every other one written over in place."""
    s = table(spark, d, "supplier")
    text = lambda word: s.select("s_suppkey", F.concat(F.lit("c"), "s_suppkey").alias("stem"), F.concat(F.lit(word), "s_name").alias("text"))
    folder = Written(spark, "files").root
    actions.export_texts(text("old "), folder)
    actions.export_texts(text("new ").where("s_suppkey % 2 = 0"), folder, overwrite=True)
    return sources.captions(spark, folder).select("file", "text")


@query("""SELECT kind, 'page ' || s_suppkey || ' of ' || s_nationkey || CASE kind WHEN 'masks' THEN '_mask.png' ELSE '.json' END AS file, row_number() OVER (PARTITION BY kind ORDER BY s_suppkey) AS place
FROM supplier, LATERAL (SELECT unnest(['masks', 'annotations']) AS kind) WHERE kind = 'masks' OR s_suppkey % 3 > 0""")
def files_by_kind(spark, d):
    """The masks and the annotations of a folder, each kind in natural order."""
    s = table(spark, d, "supplier")
    stem = F.concat(F.lit("page "), "s_suppkey", F.lit(" of "), "s_nationkey")
    made = s.select(F.concat(stem, F.lit("_mask.png")).alias("file"), F.lit(b"m").alias("content"))
    made = made.unionByName(s.where("s_suppkey % 3 > 0").select(F.concat(stem, F.lit(".json")).alias("file"), F.unhex(F.lit("")).alias("content")))
    folder = _folder(spark, made)
    out = None
    for kind, ends in (("masks", (".png",)), ("annotations", (".json",))):
        one = pairing.in_order(sources.listing(spark, folder, ends)).select(F.lit(kind).alias("kind"), "file", "place")
        out = one if out is None else out.unionByName(one)
    return out


def _named(spark, d):
    n = table(spark, d, "nation")
    images = pairing.with_names(n.select(F.concat("n_name", F.lit(".png")).alias("file")))
    captions = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("stem"), F.concat("n_name", F.lit(".txt")).alias("file"))
    return n, images, captions


@query(
    """SELECT n_name || '.png' AS src, 'bad/' || n_name || '.png' AS dst, 'move' AS action FROM nation WHERE n_regionkey = 1
UNION ALL SELECT n_name || '.txt', 'bad/' || n_name || '.txt', 'move' FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0"""
)
def plan_moves(spark, d):
    n, _, captions = _named(spark, d)
    hits = n.where("n_regionkey = 1").select(F.concat("n_name", F.lit(".png")).alias("image"))
    return actions.move_with_captions(hits, captions, "bad")


@query(
    """SELECT n_name || '.txt' AS src, NULL::VARCHAR AS dst, 'delete' AS action FROM nation WHERE n_nationkey % 4 = 0
UNION ALL SELECT n_name || '.png', 'again/' || n_name || '.png', 'move' FROM nation WHERE n_nationkey % 4 = 0"""
)
def plan_retries(spark, d):
    _, images, captions = _named(spark, d)
    refused = captions.join(table(spark, d, "nation").where("n_nationkey % 4 = 0").select(F.col("n_name").alias("stem")), "stem", "left_semi")
    return actions.retry_refused(refused, images)


@query(
    """WITH f AS (SELECT n_name, n_nationkey, 'img' || lpad((row_number() OVER (ORDER BY n_nationkey))::VARCHAR, 3, '0') AS new FROM nation),
p AS (SELECT n_name || '.png' AS file, new || '.png' AS new FROM f UNION ALL SELECT n_name || '.txt', new || '.txt' FROM f WHERE n_nationkey % 2 = 0)
SELECT 1 AS phase, file AS src, '__tmp__' || file AS dst, 'rename' AS action FROM p UNION ALL SELECT 2, '__tmp__' || file, new, 'rename' FROM p"""
)
def plan_renames(spark, d):
    _, images, captions = _named(spark, d)
    return actions.rename(images.select("file"), captions, "img", 1, 3)


@query("""SELECT 'mask_' || n_regionkey || '_' || CASE WHEN n_nationkey % 2 = 0 THEN 'male' ELSE 'female' END || '_' || n_name || '.png' AS file FROM nation""")
def mask_names(spark, d):
    gender = F.when(F.col("n_nationkey") % 2 == 0, "male").otherwise("female")
    return table(spark, d, "nation").select(actions.mask_name("mask", F.col("n_regionkey"), gender, F.col("n_name")).alias("file"))


@query("""SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '.png' WHEN n_nationkey % 3 = 1 THEN n_name || '_mask.png' END AS image FROM nation""")
def mask_images(spark, d):
    """A mask's image by its stem, else the mask itself."""
    n = table(spark, d, "nation")
    masks = n.where("n_nationkey % 3 < 2").select(F.col("n_name").alias("stem"), F.concat("n_name", F.lit("_mask.png")).alias("mask"))
    images = pairing.with_names(n.where("n_nationkey % 3 = 0").select(F.concat("n_name", F.lit(".png")).alias("file")))
    found = pairing.image_of_mask(masks, images)
    return n.select(F.col("n_name").alias("name")).join(found.select(F.col("stem").alias("name"), "image"), "name", "left")

