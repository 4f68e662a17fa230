"""JPEG files against the JVM's own reader and writer, and reductions against plain sums."""

import struct
import zlib
from urllib.parse import unquote

import numpy as np
import pytest

from tessera.operators import actions, neighbors
from tessera.sources import jpeg, pictures, png


def test_jpeg_files_are_read_as_they_were_written(spark, tmp_path):
    rng = np.random.default_rng(1)
    grey = rng.integers(0, 256, (21, 35)).astype(np.uint8)
    colour = rng.integers(0, 256, (17, 8, 3)).astype(np.uint8)
    alpha = np.zeros((4, 5, 4), np.uint8)
    files = {"a b+c%20é.JPG": jpeg.encode(grey), "c.jpeg": jpeg.encode(colour), "p.png": png.encode(colour), "g.png": png.encode(grey), "t.png": png.encode(alpha), "broken.jpg": b"\xff\xd8no", "cut.jpg": b"", "notes.txt": b"x"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    found = pictures.pictures(spark, f"file://{tmp_path}")
    got = {r.file: r for r in found.collect()}
    assert set(got) == set(files) - {"notes.txt"}
    for name, want in (("a b+c%20é.JPG", grey), ("c.jpeg", colour), ("p.png", colour), ("g.png", grey), ("t.png", alpha)):
        r = got[name]
        values = pictures.pixels(r.data, r.width, r.height, r.channels)
        assert values.shape == want.shape and np.abs(values.astype(int) - want).max() <= (0 if name.endswith("png") else 3), name
    assert got["broken.jpg"].error and got["broken.jpg"].data is None and got["cut.jpg"].error and got["p.png"].error is None
    values = {r.file: (r["values"], r.error) for r in pictures.grey_values(found, 5, 3).collect()}
    want = [[grey[a * 7 : a * 7 + 7, b * 7 : b * 7 + 7].mean() for b in range(5)] for a in range(3)]
    assert np.abs(np.array(values["g.png"][0]).reshape(3, 5) - want).max() <= 0.5 and values["broken.jpg"] == (None, "not a picture")
    rasters = {r.image: r.raster for r in pictures.rasters(found).collect()}
    assert set(rasters["t.png"]) == {255} and len(rasters["g.png"]) == 21 * 35 * 3 and rasters["p.png"] == colour.tobytes() and rasters["cut.jpg"] is None


def test_any_reduction_keeps_the_mean():
    rng = np.random.default_rng(2)
    for h, w in ((1, 1), (8, 9), (5, 30), (100, 7), (8, 1000)):
        v = rng.integers(0, 256, (h, w))
        small = pictures.area_mean(v, 9, 8)
        assert small.shape == (8, 9) and np.isclose(small.mean(), v.mean())
    assert np.allclose(pictures.area_mean(np.kron(v[:, :9], np.ones((3, 4))), 9, 8), v[:, :9])


def test_hashes_of_scaled_copies_are_near(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (16, 18)).astype(float)
    large = np.kron(base, np.ones((6, 5)))
    for name, v in (("one", large), ("half", pictures.area_mean(large, 45, 48)), ("other", 255 - large)):
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(np.rint(v).astype(np.uint8), 4))
    values = pictures.grey_values(pictures.pictures(spark, f"file://{tmp_path}"))
    hashes = values.select("file", neighbors.difference_hash(values["values"], row=9).alias("hash"))
    got = {r.file: r.hash & (1 << 64) - 1 for r in hashes.collect()}
    assert (got["one.jpg"] ^ got["half.jpg"]).bit_count() <= 6 < 40 < (got["one.jpg"] ^ got["other.jpg"]).bit_count()


def test_written_jpegs(spark, tmp_path):
    rows = [("a", 3, 2, bytearray(range(6))), ("b", 2, 2, bytearray(range(12))), ("c", None, None, None)]
    made = jpeg.written_jpegs(spark.createDataFrame(rows, "mask_id string, width int, height int, raster binary"))
    files = {r.mask_id: r.content for r in made.collect()}
    assert files["c"] is None
    actions.export_files(made.where("content IS NOT NULL").selectExpr("mask_id || '.jpg' AS file", "content"), f"file://{tmp_path}/out")
    got = {r.file: (r.width, r.height, r.channels) for r in pictures.pictures(spark, f"file://{tmp_path}/out").collect()}
    assert got == {"a.jpg": (3, 2, 1), "b.jpg": (2, 2, 3)}


def test_only_files_that_are_no_plain_png_are_left_to_the_image_reader(spark, tmp_path, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    rng = np.random.default_rng(4)
    colour, alpha = rng.integers(0, 256, (5, 7, 3)).astype(np.uint8), rng.integers(0, 256, (3, 2, 4)).astype(np.uint8)
    whole = png.encode(colour)
    made = {f"{k} +%é.png": png.encode(colour[:, :, 0] + np.uint8(k)) for k in range(50)} | {"c.PNG": whole, "a.png": png.encode(alpha), "_hidden.png": whole, "empty.png": b"", "notes.md": b"x"}
    (tmp_path / "plain").mkdir()
    for name, body in made.items():
        (tmp_path / "plain" / name).write_bytes(body)
    (tmp_path / "plain" / "sub.png").mkdir()
    with monkeypatch.context() as m:  # of these readers' index and tasks the driver would hold every name
        m.setattr(DataFrameReader, "format", lambda self, kind: pytest.fail(kind))
        got = {r.file: r for r in pictures.pictures(spark, f"file://{tmp_path}/plain").collect()}
    assert set(got) == set(made) - {"_hidden.png", "notes.md"} and {k for k, r in got.items() if r.error} == {"empty.png"}
    for name, want in [("c.PNG", colour), ("a.png", alpha), *[(f"{k} +%é.png", colour[:, :, 0] + np.uint8(k)) for k in range(50)]]:
        assert np.array_equal(pictures.pixels(got[name].data, got[name].width, got[name].height, got[name].channels), want), name
    # What Spark's reader says of the same files, and of others beside them, is said still.
    lines = np.concatenate([np.full((5, 1), 4, np.uint8), rng.integers(0, 256, (5, 21)).astype(np.uint8)], 1)
    pack = lambda head, *chunks: png.SIGNATURE + png._chunk(b"IHDR", struct.pack(">IIBBBBB", *head)) + b"".join(png._chunk(*c) for c in chunks) + png._chunk(b"IEND", b"")
    one = lambda data: (b"IDAT", zlib.compress(data))
    odd = {
        "paeth.png": pack((7, 5, 8, 2, 0, 0, 0), one(lines.tobytes())), "deep.png": pack((1, 1, 16, 0, 0, 0, 0), one(b"\0\7\1")),
        "palette.png": pack((2, 1, 8, 3, 0, 0, 0), (b"PLTE", bytes(range(6))), one(b"\0\1\0")), "clear.png": pack((2, 1, 8, 2, 0, 0, 0), (b"tRNS", bytes([0, 1, 0, 2, 0, 3])), one(bytes([0, 1, 2, 3, 4, 5, 6]))),
        "jpeg.png": jpeg.encode(colour), "cut.png": whole[:-20], "sum.png": whole[:-1] + b"x", "more.png": whole + b"x", "j.jpg": jpeg.encode(colour), "no.gif": b"no", "none.jpg": b"",
    }
    for name, body in odd.items():
        (tmp_path / "plain" / name).write_bytes(body)
    there = {unquote(r.origin).rsplit("/", 1)[1]: r for r in spark.read.format("image").option("pathGlobFilter", "*.{png,PNG,jpg,gif}").load(f"file://{tmp_path}/plain").select("image.*").collect()}
    got = {r.file: r for r in pictures.pictures(spark, f"file://{tmp_path}/plain").collect()}
    assert set(got) == set(made) - {"_hidden.png", "notes.md"} | set(odd) and len(there) == len(got) - 2
    for name, r in got.items():
        seen = there.get(name)
        want = (seen.width, seen.height, seen.nChannels, seen.data, None) if seen and seen.height > 0 else (None, None, None, None, "not a picture")
        assert (r.width, r.height, r.channels, r.data, r.error) == want, name


def test_every_pixel_of_colour_pictures(spark):
    rows = spark.createDataFrame([("a", 2, 2, bytearray(range(250, 256)) + bytearray(range(6))), ("b", None, None, None), ("c", 1, 1, bytearray([9, 8, 7]))], "image string, width int, height int, raster binary").coalesce(1)
    assert sorted(map(tuple, pictures.colours(rows).collect())) == [("a", 0, 0, 250, 251, 252), ("a", 0, 1, 253, 254, 255), ("a", 1, 0, 0, 1, 2), ("a", 1, 1, 3, 4, 5), ("c", 0, 0, 9, 8, 7)]
