"""Relational operators against plain versions and hand-made cases."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry
from tessera.operators import actions, boxes, masks, neighbors, pairing, quality, runs, scores, skeleton, tags


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(spark, *names):
    return pairing.with_names(spark.createDataFrame([(n,) for n in names], "file string"))


def test_pairing(spark):
    images = files(spark, "a.PNG", "a.jpg", "b.webp", "c.gif", "x.txt").where("ext <> '.txt'")
    captions = spark.createDataFrame([("a", "t"), ("d", "u")], "stem string, text string")
    assert rows(pairing.with_image(captions, images).select("stem", "image")) == [("a", "a.jpg"), ("d", None)]
    assert rows(pairing.unpaired(images, captions)) == [("b",), ("c",)] and rows(pairing.unpaired(captions, images)) == [("d",)]
    assert rows(pairing.paired(captions, images).select("stem")) == [("a",)]
    assert pairing.all_images(captions, images).count() == 2
    assert rows(pairing.with_caption_flag(images, captions).select("file", "has_txt")) == [("a.PNG", True), ("a.jpg", True), ("b.webp", False), ("c.gif", False)]
    s = pairing.folder_stats(images, captions).first()
    assert tuple(s) == (4, 2, 1, 2, 1)
    assert rows(pairing.extension_histogram(images)) == [(".gif", 1), (".jpg", 1), (".png", 1), (".webp", 1)]


def test_numbering(spark):
    names = [f"img{k}.png" for k in range(1, 130)]
    random.Random(1).shuffle(names)
    plan = {r.file: r.new_file for r in pairing.numbered(files(spark, *names), "n", 9, 2).collect()}
    assert plan == {f"img{k}.png": f"n{k + 8:02d}.png" for k in range(1, 130)}


def test_lookups(spark):
    items = spark.createDataFrame([(1, "h1", "p1"), (2, "h2", "p2"), (3, "h3", None)], "key int, md5 string, post_id string")
    a = spark.createDataFrame([("h1", "A")], "md5 string, tags string")
    b = spark.createDataFrame([("p1", "B"), ("p2", "C")], "post_id string, tags string")
    assert rows(pairing.looked_up(items, a, b).select("key", "tags")) == [(1, "A"), (2, "C"), (3, None)]


def test_inventory_and_matches(spark):
    captions = spark.createDataFrame([(1, "Long Hair, a, a\n\ncap, b"), (2, "long_hair,c"), (3, "")], "key int, text string")
    assert rows(tags.inventory(captions, "key", "text")) == [("a", "a", 1), ("c", "c", 1), ("long_hair", "Long Hair", 2)]
    body = spark.createDataFrame([("3girls, 2boys",), ("1girl,1boy",), ("1girl",), ("2boys, 2girls",), ("full_body, Portrait",)], "t string")
    from tessera.functions import text

    got = [r[0] for r in body.select(tags.persons(text.tokens(F.col("t")))).collect()]
    assert [tuple(g) if g else None for g in got] == [(3, "3girls", "high"), None, None, (2, "2girls", "medium"), None]
    assert rows(tags.composition(body, "t")) == [("full_body", 1), ("untagged", 4)]
    hits = quality.person_hits(body.withColumn("k", F.monotonically_increasing_id()), "k", "t")
    assert sorted(r.matched_tag for r in hits.collect()) == ["1girl+1boy", "2girls", "3girls"]


def test_checks(spark):
    captions = spark.createDataFrame([(1, ""), (2, "I cannot"), (3, "x" * 20), (4, "I'm sorry, that is a long answer"), (5, None)], "k int, t string")
    assert rows(quality.caption_issues(captions, "k", "t")) == [(1, "empty"), (2, "apology"), (2, "short"), (4, "apology"), (5, "empty")]
    images = spark.createDataFrame([("a", 700, 900, None), ("b", 300, 1000, None), ("c", 10, 0, None), ("d", 1, 1, "bad"), ("e", 2500, 1000, None)], "image string, width int, height int, error string")
    assert {r.image for r in quality.small_images(images).collect()} == {"a", "b", "c"}
    assert rows(quality.odd_shapes(images)) == [("b", 0.3, "narrow")]
    checks = spark.createDataFrame([("critical", 10, 5), ("high", 0, 0), ("medium", 4, 9), ("info", 3, 3)], "severity string, total_checked long, count long")
    assert tuple(quality.health(checks).first()) == (60, 5)
    assert tuple(quality.health(checks.limit(0)).first()) == (100, 0)


def test_hamming_join_and_thinning(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(30)]
    hashes = [(k, base[k % 30] ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 8)))) for k in range(150)] + [(900, None), (901, base[0]), (902, base[0])]
    df = spark.createDataFrame(hashes, "id int, hash long")
    got = neighbors.near_pairs(df, 10)
    brute = {(a, b) for (a, x), (b, y) in combinations([h for h in hashes if h[1] is not None], 2) if bin(x ^ y).count("1") <= 10}
    pairs = [(r.a, r.b) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) <= brute
    label = {}
    for a, b in brute:
        for x in (a, b):
            label.setdefault(x, x)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in sorted(brute):
        x, y = sorted((root(a), root(b)))
        label[y] = x
    assert {r.id: r.component for r in neighbors.components(got).collect()} == {i: root(i) for i in label}
    assert {r.id: r.component for r in neighbors.similar(df, 10).collect()} == {i: root(i) for i in label}
    for size, keep in ((2, 2), (7, 2), (8, 2), (10, 3)):
        thin = neighbors.thin(spark.range(size).select(F.col("id"), F.lit(0).alias("component")))
        assert thin.where("keep").count() == keep
    half = spark.range(4000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 5 WHEN id % 100 = 1 THEN 4 ELSE id * 7919 * 65537 END AS hash")
    got = {r.id: r.component for r in neighbors.similar(half, 2).collect()}
    assert sum(c == 0 for c in got.values()) >= 2040 and got[3998] == got[101] == 0
    assert sum(r.b != 1 and r.a == 0 for r in neighbors.near_pairs(half, 2).collect()) >= 1999
    kept = neighbors.thin(spark.range(3000).selectExpr("id", "CASE WHEN id < 2900 THEN 0 ELSE id END AS component"))
    assert kept.where("component = 0 AND keep").count() == 870 and kept.where("component > 0 AND keep").count() == 100
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a int, b int")
    assert {r.component for r in neighbors.components(chain).collect()} == {0}
    assert neighbors.components(chain.limit(0)).count() == 0


def test_difference_hash(spark):
    image = [(k * 37) % 11 for k in range(72)]
    want = int("".join("1" if image[r * 9 + c] > image[r * 9 + c + 1] else "0" for r in range(8) for c in range(8)), 2)
    got = spark.createDataFrame([(image,)], "v array<int>").select(neighbors.difference_hash(F.col("v"), 9)).first()[0]
    assert got % (1 << 64) == want


def test_scores(spark):
    logits = [("i", 0, 0.0), ("i", 1, float("nan")), ("i", 2, float("inf")), ("i", 3, 99.0), ("i", 4, 1.0), ("i", 5, 1.0), ("i", 9, 5.0)]
    words = [(0, "g0", "general"), (1, "g1", "general"), (2, "c2", "character"), (3, None, "general"), (4, "r4", "rating"), (5, "r5", "rating")]
    named = scores.named(spark.createDataFrame(logits, "image string, idx int, logit double"), spark.createDataFrame(words, "idx int, tag string, category string"))
    p = {r.tag: r.probability for r in named.collect()}
    assert set(p) == {"g0", "g1", "c2", "r4", "r5"} and p["g0"] == p["g1"] == 0.5 and abs(p["c2"] - 1 / (1 + np.exp(-1))) < 1e-12
    assert {r.tag for r in scores.above(named, 0.5, 0.9).collect()} == {"g0", "g1", "r4", "r5"}
    assert {r.tag for r in scores.above(named, 0.5, 0.9, strict=True).collect()} == {"r4", "r5"}
    assert scores.best(named, "rating").first().tag == "r4"
    assert {(r.tag, r.place) for r in scores.top(named, 1).collect()} == {("g0", 1), ("c2", 1), ("r4", 1)}
    lists = {r.category: r.tags for r in scores.tag_lists(named, {"general": 0.5, "character": 0.5}).collect()}
    assert lists["rating"] == ["r4", "r5"]


def b(*v):
    return dict(zip(("x1", "y1", "x2", "y2"), v, strict=True))


DET = "image string, part string, label string, bbox struct<x1:int,y1:int,x2:int,y2:int>, score double"


def test_suppression_is_greedy(spark):
    found = [("i", "A", "l", b(0, 0, 10, 10), 0.9), ("i", "B", "l", b(3, 0, 13, 10), 0.8), ("i", "C", "l", b(6, 0, 16, 10), 0.7), ("i", "D", "m", b(0, 0, 10, 10), 0.1), ("i", "Z", "l", b(5, 5, 5, 5), 0.05)]
    kept = boxes.suppress(spark.createDataFrame(found, DET), 0.5)
    assert {r.part for r in kept.collect()} == {"A", "C", "D", "Z"}


def test_boxes(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    x = lambda *v: geometry.box(*map(F.lit, v))
    assert one(geometry.iou(x(0, 0, 2, 2), x(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert one(geometry.iou(x(0, 0, 2, 2), x(2, 0, 4, 2))) == 0 and one(geometry.iou(x(0, 0, 0, 0), x(0, 0, 0, 0))) == 0
    assert tuple(one(geometry.shrink(x(0, 0, 10, 5), 0.5))) == (2, 1, 8, 4)
    assert tuple(one(geometry.shrink(x(0, 0, 1, 1), 0.1))) == (0, 0, 1, 1)
    assert tuple(one(geometry.clamp(x(-5, 3, 99, 3), F.lit(10), F.lit(8)))) == (0, 3, 10, 4)
    made = geometry.from_centre(*map(F.lit, (50.0, 40.0, 20.0, 10.0, 2.0, 4.0, 0.0)), F.lit(25), F.lit(100), True)
    assert tuple(one(made)) == (18, 17, 25, 22)
    assert one(geometry.probability(F.lit(0.4))) == 0.4 and one(geometry.probability(F.lit(2.0))) == pytest.approx(0.8807970779)


def test_persons_parts_and_strategies(spark):
    images = spark.createDataFrame([("i", 100, 100), ("none", 10, 20)], "image string, width int, height int")
    found = [("i", "p", "person", b(0, 0, 50, 50), 0.9), ("i", "q", "person", b(60, 60, 100, 100), 0.8), ("i", "s", "person", b(0, 0, 5, 5), 0.9)]
    people = boxes.persons(spark.createDataFrame(found, DET), images, 0.01)
    assert rows(people.select("image", "person_id", "area")) == [("i", 0, 2500), ("i", 1, 1600), ("none", 0, 200)]
    parts = [("i", "hand", "l", b(10, 10, 20, 20), 1.0), ("i", "foot", "l", b(70, 70, 95, 95), 1.0), ("i", "far", "l", b(0, 95, 2, 97), 1.0)]
    m = boxes.box_matches(spark.createDataFrame(parts, DET), people)
    assert rows(boxes.assign(m).select("part", "person_id")) == [("foot", 1), ("hand", 0)]
    scored = spark.createDataFrame([("i", "x", 0, 0.5), ("i", "x", 1, 0.09), ("i", "x", 2, 0.05), ("j", "x", 0, 0.14)], "image string, part string, person_id int, score double")
    assert rows(boxes.assign(scored).select("image", "person_id")) == [("i", 0)]
    assert rows(boxes.assign(scored, shared=True).select("image", "person_id")) == [("i", 0), ("i", 1)]
    who = spark.createDataFrame([("i", 0, "male"), ("i", 1, "?"), ("i", 2, None), ("i", 3, "female")], "image string, person_id int, gender string")
    have = spark.createDataFrame([("i", 0, "a"), ("i", 1, "a"), ("i", 1, "b"), ("i", 3, "z")], "image string, person_id int, part string")
    pick = lambda **s: rows(boxes.apply_strategy(who, have, s).select("person_id", "part"))
    assert pick(male=("full_body", []), female=("custom", ["b"])) == [(0, "a"), (1, "b"), (2, "person_bbox"), (3, "z")]
    assert pick(male=("custom", ["__skip__"]), female=("custom", [])) == []
    tag_scores = spark.createDataFrame([(1, "g", 0.2), (1, "b", 0.6), (2, "g", 0.3), (2, "b", 0.4), (3, "g", 0.7), (3, "b", 0.7)], "key int, tag string, probability double")
    assert rows(boxes.gender(tag_scores, ["g"], ["b"])) == [(1, "male", 0.6), (2, "female", 0.5), (3, "female", 0.7)]


def test_layers_and_sets(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    n = F.lit
    assert one(masks.layer_merge(n(255), n(255), n(255))) == 255 and one(masks.layer_merge(n(0), n(255), n(255))) == 0
    assert one(masks.layer_merge(n(255), n(9), n(0), "replace")) == 9 and one(masks.layer_merge(n(1), n(2), n(255), "additive")) == 2
    assert one(masks.soft_merge(n(1.0), n(1.0), n(1.0))) == 1 and one(masks.soft_merge(n(1.0), n(0.0), n(1.0))) == 0 and one(masks.soft_merge(n(0.0), n(1.0), n(1.0), True)) == 0
    with pytest.raises(ValueError, match="unknown mode"):
        masks.layer_merge(n(1), n(1), n(1), "x")
    pixels = spark.createDataFrame([("i", "a", 0, 0, 255), ("i", "b", 0, 0, 99), ("i", "b", 0, 1, 5)], "image string, mask_id string, y int, x int, v int")
    assert rows(masks.merge(pixels, "image", 2)) == [("i", 0, 0, 255), ("i", 0, 1, 5)] and rows(masks.merge(pixels, "image", 2, "intersection")) == [("i", 0, 0, 99)]
    boxes_ = spark.createDataFrame([("m", 0, 0, 2, 2), ("m", 1, 1, 3, 2), ("m", 4, 4, 4, 9)], "mask_id string, x1 int, y1 int, x2 int, y2 int")
    assert masks.box_pixels(boxes_).count() == 5


def test_regions_and_shapes(spark):
    rng = np.random.default_rng(3)
    mask = np.where(rng.random((40, 50)) < 0.35, 255, 0).astype(np.uint8)
    seen, found = np.zeros(mask.shape, bool), []
    for y, x in np.argwhere(mask > 127):
        if seen[y, x]:
            continue
        stack, own = [(y, x)], []
        seen[y, x] = True
        while stack:
            cy, cx = stack.pop()
            own.append((cy, cx))
            for ny in range(max(0, cy - 1), min(40, cy + 2)):
                for nx in range(max(0, cx - 1), min(50, cx + 2)):
                    if mask[ny, nx] > 127 and not seen[ny, nx]:
                        seen[ny, nx] = True
                        stack.append((ny, nx))
        found.append(sorted(own))
    assert sorted(sorted(map(tuple, p)) for p in masks.label_regions(mask)) == sorted(found)
    square = np.zeros((40, 40), np.uint8)
    square[10:30, 5:25] = 255
    square[0, 0] = 255
    assert masks.region_boxes(square) == [(5, 10, 25, 30, 400)]
    assert masks.keep_regions(square, min_area=2).sum() == 400 * 255 and masks.keep_regions(square, max_area=50).sum() == 255
    [outline] = masks.outline(square)
    assert sorted(map(tuple, outline)) == [(5, 10), (5, 29), (24, 10), (24, 29)]
    assert np.array_equal(masks.fill_polygon(outline, 40, 40), masks.keep_regions(square, min_area=2))
    assert masks.fill_polygon([(0, 0), (9, 0)], 10, 10).any() and not masks.fill_polygon([(0, 0)], 10, 10).any()
    assert masks.fill_polygon([(-5, -5), (60, -5), (60, 60), (-5, 60)], 10, 10).all()
    holed = square.copy()
    holed[18, 12] = 0
    assert np.array_equal(masks.close_open(holed, close=3)[12:28, 7:23], square[12:28, 7:23]) and masks.close_open(square, open_=3)[0, 0] == 0
    assert masks.dilate(square, 3).sum() > square.sum() and np.array_equal(masks.dilate(square, 1), square)
    assert masks.smooth(square, 5)[0, 0] == 0 and np.array_equal(masks.smooth(square, 1), square)
    raster = spark.createDataFrame([("m", 40, 40, square.tobytes()), ("n", 1, 1, None)], "mask_id string, width int, height int, raster binary")
    assert rows(masks.regions(raster)) == [("m", 0, 5, 10, 25, 30, 400)]
    inverted = masks.per_mask(masks.per_mask(raster, lambda m: 255 - m), lambda m: 255 - m)
    assert [r.raster for r in inverted.orderBy("mask_id").collect()] == [square.tobytes(), None]


def test_skeletons(spark):
    points = [("i", 200, 200, 0, k, 20 + 8 * k, 30 + 9 * k, 0.9) for k in range(17)] + [("j", 50, 50, 0, 0, 1, 1, 0.9)]
    kp = spark.createDataFrame(points, "image string, width int, height int, person int, idx int, x int, y int, conf double")
    for part, pieces in (("arms", 4), ("legs", 4), ("torso", 1), ("neck", 1), ("feet", 2)):
        got = {r.image: (r.pieces, any(r.raster)) for r in skeleton.skeleton_masks(kp, part).collect()}
        assert got["i"][0] == pieces and got["j"] == (0, False)


def test_plans(spark):
    images = files(spark, "b2.png", "b10.jpg", "c.png")
    captions = spark.createDataFrame([("b2", "b2.txt", "tag one, tag\nCaption: A cat."), ("c", "c.txt", "only, tags")], "stem string, file string, text string")
    plan = rows(actions.rename(images, captions, "n", 1, 3))
    assert (2, "__tmp__b2.txt", "n001.txt", "rename") in plan and (1, "b10.jpg", "__tmp__b10.jpg", "rename") in plan and len(plan) == 10
    hits = spark.createDataFrame([("b2.png",)], "image string")
    assert rows(actions.move_with_captions(hits, captions, "bad")) == [("b2.png", "bad/b2.png", "move"), ("b2.txt", "bad/b2.txt", "move")]
    refused = captions.where("stem = 'c'").select("stem", "file")
    assert rows(actions.retry_refused(refused, images)) == [("c.png", "again/c.png", "move"), ("c.txt", None, "delete")]
    exported = rows(actions.split_export(captions, images, "set"))
    assert exported == [("set-caption", "b2.txt", "A cat.", "b2.png"), ("set-tag", "b2.txt", "tag one, tag", "b2.png"), ("set-tag", "c.txt", "only, tags", "c.png")]


def test_combining_resizing_and_painting(spark):
    kind = "image string, y int, x1 int, x2 int"
    a, b_ = spark.createDataFrame([("i", 0, 0, 2)], kind), spark.createDataFrame([("i", 0, 1, 2), ("i", 2, 2, 3)], kind)
    count = lambda op: runs.pixels(runs.combine(a, b_, op), ["image"]).count()
    assert [count(op) for op in ("union", "intersection", "json_only", "mask_only", "whatever")] == [3, 1, 2, 2, 3]
    small = np.array([[0, 255], [255, 0]], np.uint8)
    assert np.array_equal(masks.resize(small, 4, 4, nearest=True), np.kron(small, np.ones((2, 2), np.uint8)))
    assert np.allclose(masks.resize(small, 2, 2), small)
    assert masks.from_probabilities(np.array([[0.9, 0.1]]), 4, 1).tolist() == [[255, 255, 0, 0]]
    noisy = np.zeros((30, 30), np.uint8)
    noisy[5:20, 5:20] = 255
    noisy[10, 10], noisy[28, 28] = 0, 255
    done = masks.postprocess(noisy, close=3, grow=3, min_share=0.01)
    assert done[10, 10] == 255 and done[28, 28] == 0 and done.sum() > 225 * 255
    image = np.ones((30, 30, 3), np.uint8)
    assert (masks.paint(image, noisy, (9, 8, 7))[6, 6] == (9, 8, 7)).all() and image[6, 6, 0] == 1


def test_near_dups_take_hashes_within_sixteen_bits(spark, tmp_path):
    from tessera.plans import catalog

    falls = lambda n: [float(100 * i - (150 if i % 2 and i < 2 * n else 0)) for i in range(64)]
    rows = [(1, falls(0)), (2, falls(16)), (7, falls(17))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["near_dups"](spark, str(tmp_path)).collect())
    assert got == [(1, 2, 16), (2, 7, 1)]
