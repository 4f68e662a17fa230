"""Detections: suppression, persons, parts of persons, strategies and statistics."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry

#: Share of the threshold that further persons need for a shared part, and that groups need.
SHARED, SEVERAL = 0.8, 0.7
MATCH = 0.15


def _kept(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, most: float) -> list[int]:
    """Positions of the boxes, best first, that no kept one before them overlaps by more than ``most``."""
    size = (x2 - x1) * (y2 - y1)
    left, kept = np.arange(len(size)), []
    while len(left):
        k, left = left[0], left[1:]
        kept.append(int(k))
        w = np.minimum(x2[left], x2[k]) - np.maximum(x1[left], x1[k])
        h = np.minimum(y2[left], y2[k]) - np.maximum(y1[left], y1[k])
        both = w.clip(min=0) * h.clip(min=0)
        joint = size[left] + size[k] - both
        left = left[~((joint > 0) & (both > most * joint))]
    return kept


def suppress(detections: DataFrame, most: float = 0.5) -> DataFrame:
    """Detections (image, label, bbox, score, ...) that no better kept one of their label overlaps by more than ``most``.

    Greedy by falling score, so what a suppressed box overlaps survives; the order inside an image
    and label is (score, x1, y1, x2, y2). Images are dealt over the tasks and sorted there, and a
    batch holds many of them; a group that goes on in the next batch waits for it.
    """
    corners = ("x1", "y1", "x2", "y2")
    order = [F.col("image"), F.col("label"), F.desc("score"), *[F.col(f"bbox.{c}") for c in corners]]
    dealt = detections.repartition("image").sortWithinPartitions(*order)
    marks = [F.xxhash64("image", "label").alias("_group"), *[F.col(f"bbox.{c}").cast("double").alias(f"_{c}") for c in corners]]
    rows = dealt.select(*marks, *[F.col(f"`{c}`") for c in detections.columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            group = rest.column(0).to_numpy()
            edges = np.flatnonzero(np.diff(group)) + 1
            if len(edges):
                yield from picked(rest.slice(0, int(edges[-1])), [0, *edges.tolist()])
                rest = rest.slice(int(edges[-1]))
        if rest is not None and len(rest):
            yield from picked(rest, [0, len(rest)])

    def picked(rows: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
        boxes = [rows.column(k).to_numpy() for k in range(1, 5)]
        at = [a + k for a, b in zip(edges, edges[1:], strict=False) for k in _kept(*[c[a:b] for c in boxes], most)]
        yield from rows.take(pa.array(at, pa.int64())).select(range(5, rows.num_columns)).to_batches()

    return rows.mapInArrow(run, detections.schema)


def persons(detections: DataFrame, images: DataFrame, least: float, k: int = 15) -> DataFrame:
    """(image, person_id, bbox, confidence, area): the largest ``k`` boxes above a share of the image, renumbered.

    An image without one is one person as a whole, with confidence 1.
    """
    sized = detections.join(images.select("image", "width", "height"), "image")
    sized = sized.withColumn("area", geometry.area(F.col("bbox")).cast("long"))
    big = sized.where(F.col("area") >= F.col("width") * F.col("height") * least)
    order = Window.partitionBy("image").orderBy(F.desc("area"), F.desc("score"), "bbox")
    placed = big.withColumn("person_id", F.row_number().over(order) - 1).where(F.col("person_id") < k)
    found = placed.select("image", "person_id", "bbox", F.col("score").cast("double").alias("confidence"), "area")
    whole = images.join(found.select("image").distinct(), "image", "left_anti")
    frame = geometry.box(F.lit(0), F.lit(0), F.col("width").cast("int"), F.col("height").cast("int"))
    alone = whole.select("image", F.lit(0).alias("person_id"), frame.alias("bbox"), F.lit(1.0).alias("confidence"), (F.col("width") * F.col("height")).cast("long").alias("area"))
    return found.unionByName(alone)


def box_matches(parts: DataFrame, people: DataFrame) -> DataFrame:
    """(image, part, person_id, score) of every part box with every person of its image.

    An equi-join on the image: a detector bounds both sides by tens.
    """
    p, q = parts.select("image", "part", F.col("bbox").alias("b")), people.select("image", "person_id", F.col("bbox").alias("q"))
    b, o = F.col("b"), F.col("q")
    centre = lambda x, lo, hi: (x[lo] + x[hi]) / 2
    gap = F.sqrt(
        F.pow(centre(b, "x1", "x2") - centre(o, "x1", "x2"), 2) + F.pow(centre(b, "y1", "y2") - centre(o, "y1", "y2"), 2)
    )
    across = F.sqrt(F.pow(o["x2"] - o["x1"], 2) + F.pow(o["y2"] - o["y1"], 2))
    distance = F.when(across > 0, gap / across).otherwise(F.lit(float("inf")))
    score = geometry.match_score(geometry.overlap(b, o), geometry.area(b), geometry.area(o), distance)
    return p.join(q, "image").select("image", "part", "person_id", score.alias("score"))


def assign(matches: DataFrame, least: float = MATCH, shared: bool = False) -> DataFrame:
    """(image, part, person_id, score): each part's best person, if good enough; with ``shared`` close seconds too.

    Images of several persons need SEVERAL of the threshold. The first person wins a tie.
    """
    order = Window.partitionBy("image", "part").orderBy(F.desc("score"), "person_id")
    several = F.max("person_id").over(Window.partitionBy("image")) != F.min("person_id").over(Window.partitionBy("image"))
    rows = matches.withColumns({"_place": F.row_number().over(order), "_least": F.when(several, least * SEVERAL).otherwise(least), "_several": several})
    rows = rows.withColumn("_best", F.first("score").over(order))
    good = F.col("_best") >= F.col("_least")
    keep = good & (F.col("_place") == 1)
    if shared:
        keep = keep | (good & F.col("_several") & (F.col("score") >= F.col("_least") * SHARED))
    return rows.where(keep).select("image", "part", "person_id", "score")


def gender(tag_scores: DataFrame, girl: Sequence[str], boy: Sequence[str], least: float = 0.5) -> DataFrame:
    """(key, gender, confidence) from (key, tag, probability): male if its best tag leads and reaches ``least``."""
    top = lambda words: F.coalesce(F.max(F.when(F.col("tag").isin(*words), F.col("probability"))), F.lit(0.0))
    both = tag_scores.groupBy("key").agg(top(girl).alias("g"), top(boy).alias("b"))
    male = (F.col("b") > F.col("g")) & (F.col("b") >= least)
    sure = F.when(male, F.col("b")).when(F.col("g") >= least, F.col("g")).otherwise(F.greatest(F.lit(0.5), F.col("g")))
    return both.select("key", F.when(male, "male").otherwise("female").alias("gender"), sure.alias("confidence"))


def apply_strategy(people: DataFrame, parts: DataFrame, strategies: Mapping[str, tuple[str, Sequence[str]]], fallback: bool = True) -> DataFrame:
    """(image, person_id, part) to cover, from people (…, gender) and their parts (image, person_id, part).

    ``full_body`` takes all parts; ``custom`` those named, and without a hit all parts, then the
    person's box (part ``person_bbox``). ``__skip__`` alone or an empty list covers nothing; an
    unknown gender is female and an unknown mode custom.
    """
    entries = F.create_map(
        *[x for g, (mode, wanted) in strategies.items() for x in (F.lit(g), F.struct(F.lit(mode == "full_body").alias("all"), F.array(*map(F.lit, wanted)).cast("array<string>").alias("wanted")))]
    )
    known = F.lower(F.trim(F.coalesce("gender", F.lit(""))))
    named = F.when(known.isin("male", "female"), known).otherwise("female")
    have = parts.groupBy("image", "person_id").agg(F.sort_array(F.collect_set("part")).alias("have"))
    rows = people.join(have, ["image", "person_id"], "left").withColumn("s", entries[named])
    none = F.array().cast("array<string>")
    have_, wanted = F.coalesce("have", none), F.col("s.wanted")
    hit = F.array_intersect(have_, wanted)
    box_only = F.array(F.lit("person_bbox")) if fallback else none
    down = F.when(F.size(have_) > 0, have_ if fallback else none).otherwise(box_only)
    chosen = (
        F.when(F.col("s.all"), F.when(F.size(have_) > 0, have_).otherwise(box_only))
        .when((F.size(wanted) == 0) | (wanted == F.array(F.lit("__skip__"))), none)
        .when(F.size(hit) > 0, hit)
        .otherwise(down)
    )
    return rows.select("image", "person_id", F.explode(chosen).alias("part"))


def statistics(parts: DataFrame, enabled: int) -> DataFrame:
    """By image, from (image, has_detection, mask_pixels, width, height): parts found, rate, pixels and ratio in percent."""
    found = F.coalesce(F.col("has_detection"), F.lit(False))
    pixels = F.coalesce(F.sum(F.when(found, F.col("mask_pixels"))), F.lit(0))
    size = F.max(F.col("width").cast("long") * F.col("height"))
    return parts.groupBy("image").agg(
        F.count_if(found).alias("total_parts_detected"),
        F.lit(enabled).alias("total_parts_enabled"),
        F.bround(F.count_if(found) * 100 / F.nullif(F.lit(enabled), F.lit(0)), 2).alias("detection_rate_percent"),
        pixels.alias("total_mask_pixels"),
        F.coalesce(F.bround(pixels * 100 / F.nullif(size, F.lit(0)), 4), F.lit(0.0)).alias("total_mask_ratio_percent"),
    )


def person_chain(people: DataFrame, parts: DataFrame, strategies: Mapping[str, tuple[str, Sequence[str]]], least: float = MATCH) -> DataFrame:
    """(image, person_id, gender, part, bbox) to cover: what each person's gender says of the parts that are theirs.

    ``people`` (image, person_id, bbox, gender), ``parts`` (image, part, kind, bbox) of a detector
    that sees the whole image. Parts go to their best person, a strategy picks kinds, and the
    boxes of these come back; a person without any is covered whole (kind ``person_bbox``).
    """
    owned = assign(box_matches(parts, people), least).select("image", "part", "person_id")
    owned = owned.join(parts, ["image", "part"]).select("image", "person_id", F.col("kind").alias("part"), "bbox")
    chosen = apply_strategy(people, owned.select("image", "person_id", "part"), strategies)
    whole = people.select("image", "person_id", F.lit("person_bbox").alias("part"), "bbox")
    covered = chosen.join(owned.unionByName(whole), ["image", "person_id", "part"])
    return covered.join(people.select("image", "person_id", "gender"), ["image", "person_id"]).select("image", "person_id", "gender", "part", "bbox")


def gender_counts(people: DataFrame) -> DataFrame:
    """(image, gender, persons) from one row a person; genders as named, trimmed and in lower case."""
    named = F.coalesce(F.lower(F.trim("gender")), F.lit("unknown"))
    return people.groupBy("image", named.alias("gender")).agg(F.count(F.lit(1)).alias("persons"))


def folded_parts(detections: DataFrame) -> DataFrame:
    """(image, part, count, confidence, pixels) from one row a detection: the mean confidence and the union of the masks.

    ``pixels`` are arrays of struct(y, x); a union has each once, in order.
    """
    return detections.groupBy("image", "part").agg(
        F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("confidence"), _union("pixels").alias("pixels")
    )


def _union(pixels: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(pixels))))


def joined_models(detections: DataFrame) -> DataFrame:
    """(image, part, count, confidence, pixels) of a part that several models or scales detect, one row a detection.

    The masks are joined, the models' mean confidences averaged, and the largest count stands.
    """
    by_model = detections.groupBy("image", "part", "model").agg(
        F.count(F.lit(1)).alias("count"), F.avg("confidence").alias("confidence"), _union("pixels").alias("pixels")
    )
    return by_model.groupBy("image", "part").agg(
        F.max("count").alias("count"), F.avg("confidence").alias("confidence"), _union("pixels").alias("pixels")
    )


def of_classes(detections: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Detections of the classes named, or all if none is."""
    return detections.where(F.col("label").isin(*wanted)) if wanted else detections


def with_text(regions: DataFrame, least: int = 1) -> DataFrame:
    """Regions in whose ``text`` something was read; null says that reading failed, and keeps the region."""
    return regions.where(F.col("text").isNull() | (F.char_length(F.trim("text")) >= least))


def with_model(images: DataFrame, model, schema: str) -> DataFrame:
    """Runs a detector over (image, content): ``model()`` is built once a worker and maps a list of contents to rows.

    The boundary for inference: it takes batches of whole files and returns frames of ``schema``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = model()
        for batch in batches:
            yield detect(batch)

    return images.select("image", "content").mapInPandas(run, schema)
