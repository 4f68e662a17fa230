"""Queries of the text, tag, score and report operators that the catalog's first tables do not reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..functions import geometry, text
from ..operators import boxes, pairing, quality, scores
from ..sources import files as sources
from ..sources.tables import table
from .registry import literals_sql, query

MIXED = "p_name || ', ' || p_type || chr(13) || chr(10) || lower(p_type) || ',,' || p_brand || chr(10) || p_name"


def _mixed():
    return F.concat("p_name", F.lit(", "), "p_type", F.lit("\r\n"), F.lower("p_type"), F.lit(",,"), "p_brand", F.lit("\n"), "p_name")


@query(
    f"""WITH k AS (SELECT p_partkey, list_filter(list_transform(string_split(translate({MIXED}, chr(10) || chr(13), ',,'), ','), lambda t: trim(t)), lambda t: t <> '') AS k FROM part)
SELECT p_partkey, list_filter(k, lambda t, i: list_position(list_transform(k, lambda u: lower(u)), lower(t)) = i) AS keywords FROM k"""
)
def keyword_lists(spark, d):
    return table(spark, d, "part").select("p_partkey", text.keyword_list(_mixed()).alias("keywords"))


@query(
    f"""WITH k AS (SELECT p_partkey, list_filter(list_transform(string_split(replace({MIXED}, chr(10), ','), ','), lambda t: trim(t, ' ' || chr(13))), lambda t: t <> '') AS k FROM part)
SELECT p_partkey, k AS tags, list_concat(k, list_filter(['new tag', 'Brand#13'], lambda t: NOT list_contains(k, t))) AS extended FROM k"""
)
def tag_appends(spark, d):
    fixed = text.fixed_tags(_mixed())
    rows = table(spark, d, "part").select("p_partkey", fixed.alias("tags"))
    return rows.select("p_partkey", "tags", text.append_missing(F.col("tags"), text.literals(["new tag", "Brand#13"])).alias("extended"))


@query(
    r"""SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body, conv_id % 3 = 0 AS chinese FROM conversations"""
)
def caption_prefixes(spark, d):
    """Texts behind a prefix of any case, some with a Chinese character."""
    opened = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" CAPTION :  "), "text")).otherwise(F.col("text"))
    marked = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit("中"))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.without_prefix(opened).alias("body"), text.is_cjk(marked).alias("chinese"))


@query(
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text || chr(10) || 'more' WHEN 2 THEN text ELSE '{"other":1}' END AS answer FROM conversations"""
)
def chat_answers(spark, d):
    """The text of a chat service's answers in four layouts."""
    part = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    message = lambda c: F.array(F.struct(F.struct(c.alias("content")).alias("message")))
    layouts = [
        F.to_json(F.struct(message(F.col("text")).alias("choices"))),
        F.to_json(F.struct(message(F.array(part(F.col("text")), part(F.lit("more")))).alias("choices"))),
        F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"))),
        F.lit('{"other":1}'),
    ]
    answer = F.element_at(F.array(*layouts), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.chat_text(answer).alias("answer"))


@query(r"""SELECT conv_id, turn, 'a"b' || text || chr(10) || chr(9) || '''' AS body FROM conversations""")
def unescaped(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.unescape(F.concat(F.lit('a\\"b'), "text", F.lit("\\n\\t\\'"))).alias("body"))


@query(
    r"""WITH t AS (SELECT doc_id, doc_id % 3 AS k, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents),
f AS (SELECT doc_id, CASE k WHEN 0 THEN '```XML' || chr(10) || s || chr(10) || '```' WHEN 1 THEN '```XML' || chr(10) || s ELSE s END AS z FROM t),
l AS (SELECT doc_id, regexp_replace(z, '^\s+|\s+$', '', 'g') AS z, string_split(replace(replace(regexp_replace(z, '^\s+|\s+$', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM f),
o AS (SELECT doc_id, z, l, starts_with(lower(regexp_replace(l[1], '^\s+|\s+$', '', 'g')), '```xml') AS has_open, regexp_replace(l[-1], '^\s+|\s+$', '', 'g') = '```' AS has_close FROM l)
SELECT doc_id, CASE WHEN has_open AND has_close AND len(l) >= 2 THEN regexp_replace(array_to_string(l[2:len(l) - 1], chr(10)), '^\s+|\s+$', '', 'g') ELSE z END AS body, has_open, has_close FROM o"""
)
def fence_bodies(spark, d):
    """The text inside an XML fence, with and without its closing line, and texts without one."""
    fenced = F.concat(F.lit("```XML\n"), "s", F.when(F.col("doc_id") % 3 == 0, "\n``` ").otherwise(""))
    rows = table(spark, d, "documents").select("doc_id", text.strip(F.col("text")).alias("s"))
    found = rows.select("doc_id", text.fence_body(F.when(F.col("doc_id") % 3 == 2, F.col("s")).otherwise(fenced)).alias("f"))
    return found.select("doc_id", "f.*")


XML = ["<tags><a>{}</a></tags>", "<tags><a>{}</tags>", "<other x='1'/>", "{}", "<?xml version=\"1.0\"?><tags/>"]


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'tags' WHEN 2 THEN 'other' WHEN 4 THEN 'tags' END AS root, p_partkey % 5 IN (0, 4) AS ok FROM part"""
)
def xml_roots(spark, d):
    """The root of well-formed XML and whether it is the one asked for."""
    made = [F.replace(F.lit(x), F.lit("{}"), F.col("p_brand")) for x in XML]
    rows = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*made), (F.col("p_partkey") % 5 + 1).cast("int")).alias("xml"))
    rows = rows.select("p_partkey", text.xml_root(F.col("xml")).alias("root"))
    return rows.select("p_partkey", "root", F.coalesce(F.col("root") == "tags", F.lit(False)).alias("ok"))


def _tiers_sql(body: str) -> str:
    pick = lambda words: f"list_filter([{literals_sql(words)}], lambda k: contains(lower({body}), k))"
    high, medium, low = vocab.REFUSAL_HIGH, vocab.REFUSAL_MEDIUM, vocab.REFUSAL_LOW
    return f"""CASE WHEN len({pick(high)}) > 0 THEN {pick(high)} WHEN len({pick(medium)}) > 0 THEN {pick(medium)} ELSE {pick(low)} END"""


#: Phrases that go before some texts.
SAID = "['', 'I cannot, I''m sorry and I apologize; unable to. ', 'That is inappropriate. ', 'The policy. ', '很抱歉, 我不能 ']"
SAID_TEXTS = f"r AS (SELECT conv_id, turn, {SAID}[(conv_id + turn) % 5 + 1] || text AS body FROM conversations), p AS (SELECT conv_id, turn, {_tiers_sql('body')} AS patterns, body FROM r)"


def _said(spark, d):
    phrases = ["", "I cannot, I'm sorry and I apologize; unable to. ", "That is inappropriate. ", "The policy. ", "很抱歉, 我不能 "]
    opened = F.element_at(text.literals(phrases), ((F.col("conv_id") + F.col("turn")) % 5 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(opened, "text").alias("body"))


@query(
    f"""WITH {SAID_TEXTS} SELECT conv_id, turn, len(patterns) > 0 AS refused, list_intersect(patterns, [{literals_sql(vocab.REFUSAL_HIGH)}]) <> [] AS high,
  CASE WHEN len(patterns) = 0 THEN '低' WHEN list_has_any(patterns, [{literals_sql(vocab.REFUSAL_HIGH)}]) THEN '高' WHEN list_has_any(patterns, [{literals_sql(vocab.REFUSAL_MEDIUM)}]) THEN '中' ELSE '低' END AS level,
  patterns[1:3] AS first_patterns FROM p"""
)
def refusal_levels(spark, d):
    """Refusals by the whole vocabulary, with the first three phrases of each."""
    r = text.refusal(F.col("body"))
    rows = _said(spark, d).select("conv_id", "turn", r.alias("r"))
    return rows.select("conv_id", "turn", "r.refused", (F.col("r.level") == vocab.LEVEL_HIGH).alias("high"), "r.level", F.slice("r.patterns", 1, 3).alias("first_patterns"))


@query(
    f"""WITH {SAID_TEXTS} SELECT conv_id, turn, len(list_filter([{literals_sql(vocab.REFUSAL_FLAT)}], lambda k: contains(lower(body), k))) > 0 AS refused,
  left(body, 500) AS preview FROM r"""
)
def refusal_flat(spark, d):
    """Refusals by the flat vocabulary, and a preview of each text."""
    hits = F.size(text.keyword_hits(F.col("body"), vocab.REFUSAL_FLAT)) > 0
    return _said(spark, d).select("conv_id", "turn", hits.alias("refused"), text.preview(F.col("body")).alias("preview"))


@query("""SELECT p_brand AS tag, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS place FROM part GROUP BY p_brand""")
def tag_ranking(spark, d):
    counted = table(spark, d, "part").groupBy(F.col("p_brand").alias("tag")).agg(F.count(F.lit(1)).alias("count"))
    return pairing.placed(counted, [F.desc("count"), F.asc("tag")]).select("tag", "count", "place")


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus <> 'P') AS success FROM orders""")
def status_totals(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "❌ failed").otherwise("✅ done")
    return quality.status_fold(table(spark, d, "orders").select(status.alias("status")), "status")


@query(
    """WITH k AS (SELECT p_partkey, md5(p_name) AS h FROM part), a AS (SELECT DISTINCT md5(p_name) AS h, 'hash ' || p_name AS tags FROM part WHERE p_size % 2 = 0)
SELECT k.p_partkey AS key, coalesce(a.tags, CASE WHEN k.p_partkey % 3 = 0 THEN 'id ' || k.p_partkey END) AS tags FROM k LEFT JOIN a USING (h)"""
)
def looked_up_tags(spark, d):
    """Tags by the hash of a file, else by its post id."""
    parts = table(spark, d, "part")
    items = parts.select(F.col("p_partkey").alias("key"), F.md5("p_name").alias("md5"), F.concat(F.lit("danbooru_"), "p_partkey", F.lit(".jpg")).alias("file"))
    items = items.select("key", "md5", text.post_id(F.col("file")).alias("post_id"))
    by_hash = parts.where("p_size % 2 = 0").select(F.md5("p_name").alias("md5"), F.concat(F.lit("hash "), "p_name").alias("tags")).distinct()
    by_id = parts.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("post_id"), F.concat(F.lit("id "), "p_partkey").alias("tags"))
    return pairing.looked_up(items, by_hash, by_id).select("key", "tags")


@query(
    """SELECT vec_id AS image, (i - 1)::INT AS idx, round(embedding[i]::DOUBLE, 6) AS probability FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i)
WHERE embedding[i]::DOUBLE > CASE WHEN i - 1 < 8 THEN 0.2 ELSE 0.25 END"""
)
def strict_thresholds(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("idx", "p"))
    rows = rows.withColumn("probability", F.col("p").cast("double")).withColumn("category", F.when(F.col("idx") < 8, "artist").otherwise("general"))
    return scores.above(rows, 0.25, 0.2, strict=True).select("image", "idx", F.round("probability", 6).alias("probability"))


@query(
    """SELECT vec_id AS image, (i - 1)::INT AS idx, round(CASE WHEN embedding[i]::DOUBLE * 8 > 1 THEN 1 / (1 + exp(-embedding[i]::DOUBLE * 8)) ELSE embedding[i]::DOUBLE * 8 END, 6) AS p
FROM embeddings, LATERAL (SELECT unnest(range(1, 65)) AS i)"""
)
def maybe_logits(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("idx", "s"))
    return rows.select("image", "idx", F.round(geometry.probability(F.col("s").cast("double") * 8), 6).alias("p"))


@query(
    """WITH b AS (SELECT p_partkey AS part, (p_partkey * 13) % 300 + 0.25::DOUBLE AS cx, (p_partkey * 29) % 300 + 0.75::DOUBLE AS cy, 11.0::DOUBLE + p_size AS w, 7.0::DOUBLE + p_partkey % 90 AS h FROM part),
e AS (SELECT part, (cx - w / 2 - 10) / 0.5 AS x1, (cy - h / 2 - 20) / 0.5 AS y1, (cx + w / 2 - 10) / 0.5 AS x2, (cy + h / 2 - 20) / 0.5 AS y2 FROM b)
SELECT part, greatest(0, trunc(x1)::INT) AS x1, greatest(0, trunc(y1)::INT) AS y1, least(500, trunc(x2)::INT) AS x2, least(400, trunc(y2)::INT) AS y2,
  trunc(greatest(0, least(500, x1)))::INT AS fx1, trunc(greatest(0, least(400, y2)))::INT AS fy2 FROM e"""
)
def unletterboxed(spark, d):
    """Centre boxes of a letterboxed model on the original image, cut before and after they are clamped."""
    key = F.col("p_partkey")
    sides = [F.pmod(key * 13, F.lit(300)) + 0.25, F.pmod(key * 29, F.lit(300)) + 0.75, F.col("p_size") + 11.0, F.pmod(key, F.lit(90)) + 7.0]
    args = [c.cast("double") for c in sides] + [F.lit(0.5), F.lit(10.0), F.lit(20.0), F.lit(500), F.lit(400)]
    rows = table(spark, d, "part").select(key.alias("part"), geometry.from_centre(*args, True).alias("a"), geometry.from_centre(*args, False).alias("b"))
    return rows.select("part", "a.*", F.col("b.x1").alias("fx1"), F.col("b.y2").alias("fy2"))


ALIASES = {"breast": "chest", "bust": "chest", "feet": "foot"}


def _reports(spark, d):
    kinds = F.element_at(text.literals(["chest", "foot", "face"]), (F.col("p_partkey") % 3 + 1).cast("int"))
    file = F.when(F.col("p_size") % 4 > 0, F.concat("p_partkey", F.lit(".png")))
    return table(spark, d, "part").select(F.floor(F.col("p_partkey") / 3).alias("image"), kinds.alias("part"), (F.col("p_size") % 5 > 0).alias("has_detection"), file.alias("mask_file"))


@query(
    """SELECT p_partkey // 3 AS image, ['chest', 'foot', 'face'][p_partkey % 3 + 1] AS part, p_partkey || '.png' AS mask_file FROM part
WHERE p_size % 5 > 0 AND p_size % 4 > 0 AND p_partkey % 3 < 2"""
)
def wanted_parts(spark, d):
    """Detected parts of a report that were asked for under any of their names."""
    return sources.render_parts(_reports(spark, d), sources.alias_parts(["breast", "bust", "feet"], ALIASES))


@query(
    """SELECT p_partkey // 10 AS image, CASE p_size % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' ELSE 'unknown' END AS gender, count(*) AS persons FROM part GROUP BY 1, 2"""
)
def gender_histogram(spark, d):
    gender = F.element_at(text.literals(["male", "Female ", ""]), (F.col("p_size") % 3 + 1).cast("int"))
    rows = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("image"), F.nullif(gender, F.lit("")).alias("gender"))
    return boxes.gender_counts(rows)


@query(
    """WITH p AS (SELECT l_orderkey AS image, 'part' || l_linenumber % 3 AS part, l_discount AS confidence, l_suppkey % 7 AS x FROM lineitem WHERE l_returnflag <> 'A')
SELECT image, part, count(*) AS count, round(avg(confidence), 6) AS confidence, count(DISTINCT x) AS mask_pixels FROM p GROUP BY 1, 2"""
)
def part_folds(spark, d):
    """Detections of an image's parts folded: how many, how sure, and the union of their masks."""
    rows = table(spark, d, "lineitem").where("l_returnflag <> 'A'").select(
        F.col("l_orderkey").alias("image"), F.concat(F.lit("part"), F.col("l_linenumber") % 3).alias("part"), F.col("l_discount").alias("confidence"), F.array(F.struct(F.lit(0).alias("y"), (F.col("l_suppkey") % 7).alias("x"))).alias("pixels")
    )
    return boxes.folded_parts(rows).select("image", "part", "count", F.round("confidence", 6).alias("confidence"), F.size("pixels").cast("long").alias("mask_pixels"))


@query(
    """WITH p AS (SELECT l_orderkey AS image, l_linenumber % 2 AS model, l_discount AS confidence, l_suppkey % 7 AS x FROM lineitem),
m AS (SELECT image, model, count(*) AS n, avg(confidence) AS c FROM p GROUP BY 1, 2), u AS (SELECT image, count(DISTINCT x) AS mask_pixels FROM p GROUP BY 1)
SELECT image, max(n) AS count, round(avg(c), 6) AS confidence, any_value(mask_pixels) AS mask_pixels FROM m JOIN u USING (image) GROUP BY image"""
)
def model_unions(spark, d):
    """Two models' masks of one part joined: their union, the mean confidence and the larger count."""
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("image"), F.lit("part").alias("part"), (F.col("l_linenumber") % 2).alias("model"), F.col("l_discount").alias("confidence"), F.array(F.struct(F.lit(0).alias("y"), (F.col("l_suppkey") % 7).alias("x"))).alias("pixels")
    )
    return boxes.joined_models(rows).select("image", "count", F.round("confidence", 6).alias("confidence"), F.size("pixels").cast("long").alias("mask_pixels"))


@query(
    """SELECT l_orderkey AS image, l_linenumber AS region, l_returnflag AS label FROM lineitem WHERE l_returnflag IN ('A', 'R') AND (l_quantity > 20 OR l_discount < 0.02)"""
)
def target_classes(spark, d):
    """Detections of the classes asked for, text regions only where a text was read or reading failed."""
    read = F.when(F.col("l_discount") < 0.02, F.lit(None).cast("string")).when(F.col("l_quantity") > 20, "text").otherwise("  ")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("region"), F.col("l_returnflag").alias("label"), read.alias("text"))
    return boxes.with_text(boxes.of_classes(rows, ["A", "R"])).select("image", "region", "label")
