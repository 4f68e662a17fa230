"""PNG files, raster chains, options and places on hand-made cases."""

import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import actions, boxes, masks, neighbors, pairing
from tessera.sources import options, png


def filtered(values, kinds):
    """A PNG whose lines use the given filters, by the format's own rules."""
    h, w, step = values.shape
    rows, out = values.reshape(h, -1).astype(int), b""
    for y in range(h):
        kind, line = kinds[y % len(kinds)], []
        for x in range(w * step):
            a = rows[y, x - step] if x >= step else 0
            b = rows[y - 1, x] if y else 0
            c = rows[y - 1, x - step] if y and x >= step else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((rows[y, x] - (0, a, b, (a + b) // 2, near)[kind]) % 256)
        out += bytes([kind, *line])
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[step], 0, 0, 0)
    return png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"IDAT", zlib.compress(out)) + png._chunk(b"IEND", b"")


@pytest.mark.parametrize("step", [1, 2, 3, 4])
def test_png_filters(step):
    values = np.random.default_rng(step).integers(0, 256, (11, 7, step)).astype(np.uint8)
    got = png.decode(filtered(values, [0, 1, 2, 3, 4]))
    want = values[..., 0] if step == 1 else np.concatenate([values[..., :1]] * 3 + [values[..., 1:]], 2) if step == 2 else values
    assert np.array_equal(got, want)
    if step != 2:
        assert np.array_equal(png.decode(png.encode(want)), want)
    assert png.grey(want).shape == (11, 7)


def test_png_faults(spark):
    whole = png.encode(np.zeros((3, 4), np.uint8))
    files = [(0, whole), (1, b""), (2, None), (3, whole[:30]), (4, whole[:-20]), (5, b"GIF89a"), (6, whole.replace(b"\x08\x00", b"\x10\x00", 1))]
    rows = {r.mask_id: r for r in png.read_masks(spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in files], "file int, content binary")).collect()}
    assert (rows[0].width, rows[0].height, bytes(rows[0].raster), rows[0].error) == (4, 3, b"\0" * 12, None)
    assert all(rows[k].raster is None and rows[k].error for k in range(1, 7))
    assert png.read_masks(spark.createDataFrame([], "file int, content binary")).count() == 0


def test_rasters_and_pixels(spark):
    pixels = spark.createDataFrame([("a", 0, 1, 255), ("a", 0, 1, 7), ("a", 2, 0, 9), ("a", 9, 9, 255), ("b", -1, 0, 255), ("b", 1, 1, 255)], "mask_id string, y int, x int, v int")
    rasters = masks.rasterized(pixels, "mask_id", F.lit(3), F.lit(3))
    assert sorted(map(tuple, masks.pixels_of(rasters).collect())) == [("a", 0, 1, 255), ("a", 2, 0, 9), ("b", 1, 1, 255)]
    assert masks.pixels_of(masks.inverted(rasters)).where("mask_id = 'b'").count() == 8
    two = rasters.select(F.lit("i").alias("image"), F.col("mask_id").alias("place"), "width", "height", "raster")
    empty = two.withColumn("raster", F.lit(None).cast("binary")).withColumn("image", F.lit("j"))
    merged = masks.merged_files(two.unionByName(empty))
    assert sorted(map(tuple, masks.pixels_of(merged).collect())) == [("i", 0, 1, 255), ("i", 1, 1, 255), ("i", 2, 0, 9)]


def test_exported_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "é"), ("b", None)], "stem string, text string")
    folder = f"file://{tmp_path}/out"
    actions.export_texts(rows, folder)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {"a.txt": "é".encode(), "b.txt": b""}
    with pytest.raises(FileExistsError):
        actions.export_texts(rows, folder)
    actions.export_texts(rows, folder, overwrite=True)


def test_options():
    body = "a: 1\nb:\n  c: 'x: y' # why\n  d:\n    - p\n    - \"q # r\"\n# all\ne: ~\nf:\n- 2\ng:\n"
    assert options.parse(body) == {"a": "1", "b.c": "x: y", "b.d.0": "p", "b.d.1": "q # r", "e": None, "f.0": "2", "g": None}


def test_places(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), k) for k in range(300)]
    frame = spark.createDataFrame(rows, "n int, k int").repartition(7)
    got = pairing.placed(frame, [F.desc("n"), F.col("k")]).collect()
    assert [(r.n, r.k) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r.place for r in got) == list(range(1, 301)) and pairing.placed(frame.limit(0), [F.col("n")]).count() == 0


@pytest.mark.parametrize(("most", "bits"), [(0, 64), (3, 64), (10, 64), (16, 63)])
def test_near_pairs_are_all_found(spark, most, bits):
    rng = random.Random(most)
    hashes = []
    for k in range(40):
        base = rng.getrandbits(bits)
        hashes += [base, base] + [base ^ sum(1 << i for i in rng.sample(range(bits), rng.randint(1, most + 3))) for _ in range(3)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    frame = spark.createDataFrame([*enumerate(signed), (900, None)], "id int, hash bigint")
    pairs = {(r.a, r.b): r.distance for r in neighbors.near_pairs(frame, most, bits).collect()}
    first = {}
    for k, h in enumerate(hashes):
        first.setdefault(h, k)
    lead = sorted(first.values())
    want = {(a, b): (hashes[a] ^ hashes[b]).bit_count() for a in lead for b in lead if a < b and (hashes[a] ^ hashes[b]).bit_count() <= most}
    want |= {(first[h], k): 0 for k, h in enumerate(hashes) if first[h] != k}
    assert pairs == want
    found = neighbors.bands(most, bits)
    assert sum(w for _, w, _ in found) == bits and sum(f + 1 for *_, f in found) == most + 1


def test_suppression_across_batches(spark):
    rng = random.Random(2)
    rows = [(k % 60, f"l{k % 2}", float(rng.randint(0, 9)), *(x := (rng.randint(0, 30), rng.randint(0, 30))), x[0] + rng.randint(1, 20), x[1] + rng.randint(1, 20), k) for k in range(900)]
    frame = spark.createDataFrame(rows, "image int, label string, score double, x1 int, y1 int, x2 int, y2 int, k int")
    frame = frame.select("image", "label", "score", F.struct("x1", "y1", "x2", "y2").alias("bbox"), "k")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = boxes.suppress(frame, 0.3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for group in {r[:2] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == group), key=lambda r: (-r[2], *r[3:7])):
            size = lambda b: (b[5] - b[3]) * (b[6] - b[4])
            both = lambda a, b: max(0, min(a[5], b[5]) - max(a[3], b[3])) * max(0, min(a[6], b[6]) - max(a[4], b[4]))
            if all(both(r, q) <= 0.3 * (size(r) + size(q) - both(r, q)) for q in kept):
                kept.append(r)
        want |= {r[-1] for r in kept}
    assert len(got) == len({r.k for r in got})
    # Equal boxes with equal scores may stand for each other.
    same = {r[-1]: r[:7] for r in rows}
    assert sorted(same[r.k] for r in got) == sorted(same[k] for k in want)


def test_chains_by_part(spark):
    rng = np.random.default_rng(7)
    made = {f"m{k}": np.where(rng.random((20, 30)) < 0.6, 255, 0).astype(np.uint8) for k in range(4)}
    rows = [(k, f"p{i % 3}", 30, 20, bytearray(v.tobytes())) for i, (k, v) in enumerate(made.items())] + [("none", "p0", None, None, None)]
    rasters = spark.createDataFrame(rows, "mask_id string, part string, width int, height int, raster binary")
    steps = spark.createDataFrame([("p0", 3, None, 2, 3, 0.01, None, None, 4.0), ("p1", None, None, None, None, None, None, None, None)], "part string, close int, open int, grow int, blur int, min_share double, max_share double, min_side int, max_aspect double")
    got = {r.mask_id: r.raster for r in masks.chained(rasters, steps).collect()}
    assert got["none"] is None and got["m1"] == made["m1"].tobytes() and got["m2"] == made["m2"].tobytes()
    for k in ("m0", "m3"):
        assert got[k] == masks.postprocess(made[k], close=3, grow=2, blur=3, min_share=0.01, max_aspect=4.0).tobytes()


def test_painted_pictures(spark):
    rng = np.random.default_rng(8)
    view = rng.integers(0, 256, (4, 6, 3)).astype(np.uint8)
    images = spark.createDataFrame([(k, 6, 4, bytearray(view.tobytes())) for k in "abc"] + [("n", None, None, None)], "image string, width int, height int, raster binary")
    small = bytearray([255, 0, 127, 128, 0, 0])
    rasters = spark.createDataFrame([("a", 3, 2, small), ("b", None, None, None), ("n", 3, 2, small)], "mask_id string, width int, height int, raster binary")
    got = {r.image: r.raster for r in masks.painted(images, rasters, (9, 8, 7)).collect()}
    want = view.copy()
    want[:2, :2], want[2:, :2] = (9, 8, 7), (9, 8, 7)
    assert got["a"] == want.tobytes() and got["b"] == got["c"] == view.tobytes() and got["n"] is None
    files = png.written_masks(spark.createDataFrame([("x", 6, 4, bytearray(view.tobytes())), ("y", 1, 2, bytearray(range(8)))], "mask_id string, width int, height int, raster binary")).collect()
    assert np.array_equal(png.decode(files[0].content), view) and png.decode(files[1].content).shape == (2, 1, 4)


def test_annotation_queries_take_every_part(spark, tmp_path):
    from tessera.plans import catalog

    spark.range(1, 24).selectExpr("id AS p_partkey", "CAST(id * 3 % 50 AS int) AS p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    shapes = catalog.QUERIES["mask_annotations"](spark, str(tmp_path)).collect()
    assert sorted(r.image for r in shapes) == [k for k in range(1, 24) for _ in range(2)] and {r.corners for r in shapes} == {4}
    want = {k: 2 * (10 + k % 20) * (9 + k * 3 % 50 % 20) for k in range(1, 24)}
    assert {r.mask_id: r.pixels for r in catalog.QUERIES["annotation_masks"](spark, str(tmp_path)).collect()} == want


def test_steps_take_large_batches_in_pieces(spark):
    n = 2 * masks.MASKS_AT_ONCE + 5
    batch = pa.RecordBatch.from_pydict({"k": list(range(n))})
    assert [b.num_rows for b in masks.sliced([batch, batch.slice(0, 0)])] == [masks.MASKS_AT_ONCE, masks.MASKS_AT_ONCE, 5]
    rows = spark.range(0, n, 1, 1)
    boxes_ = rows.select("id", F.lit(1).alias("x1"), F.lit(0).alias("y1"), (F.col("id") % 3 + 2).alias("x2"), F.lit(2).alias("y2"))
    drawn = masks.drawn(boxes_, "id", F.lit(4), F.lit(3)).coalesce(1)  # more rows a batch than a piece
    of = lambda k: np.array([[0, *[255 * (x <= k % 3 + 1) for x in (1, 2, 3)]]] * 2 + [[0] * 4], np.uint8)
    read = png.read_masks(png.written_masks(masks.per_mask(drawn, masks.invert)).withColumnRenamed("mask_id", "file"))
    assert {r.mask_id: bytes(r.raster) for r in read.collect()} == {k: (255 - of(k)).tobytes() for k in range(n)}
    assert {r.mask_id: r.area for r in masks.regions(drawn, 1).collect()} == {k: 2 * (k % 3 + 1) for k in range(n)}
    pictures_ = rows.select(F.col("id").alias("image"), F.lit(4).alias("width"), F.lit(3).alias("height"), F.unhex(F.repeat(F.lit("07"), 36)).alias("raster"))
    painted = {r.image: np.frombuffer(r.raster, np.uint8).reshape(3, 4, 3) for r in masks.painted(pictures_, drawn, (1, 2, 3)).coalesce(1).collect()}
    assert len(painted) == n and all((p[of(k) > 0] == (1, 2, 3)).all() and (p[of(k) == 0] == 7).all() for k, p in painted.items())


def test_masks_beside_files_that_are_none_are_changed(spark):
    files = spark.createDataFrame([(0, bytearray(png.encode(np.full((2, 3), 9, np.uint8)))), (1, bytearray(b"none"))], "file int, content binary").coalesce(1)
    changed = {r.mask_id: r.raster for r in masks.per_mask(png.read_masks(files), masks.invert).collect()}
    assert changed == {0: bytearray([246] * 6), 1: None}
