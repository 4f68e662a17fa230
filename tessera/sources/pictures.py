"""Pixels of a folder's JPEG, PNG, GIF and BMP files: plain PNG files decoded by tasks of ours, others by Spark's own image reader in the JVM."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.masks import sliced
from ..operators.written import Written
from . import files, png

#: Endings of the files that are decoded.
DECODED = (".jpg", ".jpeg", ".png", ".gif", ".bmp")
PNG = ".png"


#: Pixels, at least, of which a batch is made.
PIXELS_AT_ONCE = 1 << 16
_PICTURE = "file string, width int, height int, channels int, data binary, error string"


def pictures(spark: SparkSession, folder: str, extensions: Sequence[str] = DECODED) -> DataFrame:
    """(file, width, height, channels, data, error): one row a file; a broken or empty one has an error and no pixels.

    ``data`` holds blue, green and red (and alpha) of each pixel by rows, or one grey byte. Plain PNG files are decoded
    by the tasks that hold their names. Only if there are others, Spark's image reader, of whose index the driver
    holds the folder, reads those of their endings.
    """
    ends = list(dict.fromkeys(e for x in extensions for e in (x, x.upper())))
    ending = F.coalesce(*[F.when(F.endswith("file", F.lit(e)), F.lit(e)) for e in ends])
    listed = files.names(spark, folder).withColumn("ending", ending).where("ending IS NOT NULL")
    seen = Written(spark, "pictures").save(_decoded(listed, folder), "seen")
    rest = seen.where("ending IS NOT NULL")
    left = [r.ending for r in rest.select("ending").distinct().collect()]  # of the endings asked for
    done = seen.where("ending IS NULL").drop("ending")
    if not left:
        return done
    rows = spark.read.format("image").option("pathGlobFilter", "{" + ",".join(f"*{e}" for e in left) + "}").load(folder).select("image.*")
    good = F.col("height") > 0
    name = F.url_decode(F.replace(F.element_at(F.split("origin", "/"), -1), F.lit("+"), F.lit("%2B")))
    kept = lambda c, new: F.when(good, F.col(c)).alias(new)
    found = rows.select(name.alias("file"), kept("width", "width"), kept("height", "height"), kept("nChannels", "channels"), kept("data", "data"), F.when(~good, "not a picture").alias("error"))
    if any(e.lower().endswith(PNG) for e in left):
        found = found.join(rest.select("file"), "file", "left_semi")
    return found.unionByName(done)


def _decoded(listed: DataFrame, folder: str) -> DataFrame:
    """Pictures (file, length, ending) that are plain PNG files or empty, without an ending; a row with nothing but its ending for each other."""
    root = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(root)
        for batch in batches:
            rows, size = [], 0
            for k, (name, length, end) in enumerate(zip(*[c.to_pylist() for c in batch.columns], strict=True), 1):
                v = png.plain(files.read_file(system, f"{path}/{name}")) if length and name.lower().endswith(PNG) else None
                if v is not None:
                    own = v if v.ndim == 2 else v[..., [2, 1, 0, *range(3, v.shape[2])]]
                    rows.append((name, v.shape[1], v.shape[0], v.size // (v.shape[0] * v.shape[1]), own.tobytes(), None, None))
                    size += v.size
                else:
                    rows.append((name, None, None, None, None, None, end) if length else (name, None, None, None, None, "not a picture", None))
                if size >= files.BYTES_AT_ONCE or k == batch.num_rows:
                    columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema)
                    rows, size = [], 0

    kinds = [pa.string(), *[pa.int32()] * 3, pa.binary(), pa.string(), pa.string()]
    schema = ["file", "width", "height", "channels", "data", "error", "ending"]
    return listed.select("file", "length", "ending").mapInArrow(run, f"{_PICTURE}, ending string")


def pixels(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """A grey (height, width) or RGB(A) (height, width, 3 or 4) array."""
    if channels == 1:
        return np.frombuffer(data, np.uint8).reshape(height, width)
    values = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return values[..., [2, 1, 0, *range(3, channels)]]


def shares(size: int, to: int) -> np.ndarray:
    """(to, size): the share that each of ``size`` cells has of each of ``to`` equal parts of their length."""
    edges, cells = np.arange(to + 1) * size / to, np.arange(size)
    low, high = np.maximum(edges[:-1, None], cells), np.minimum(edges[1:, None], cells + 1)
    return (high - low).clip(0) * to / size


def area_mean(values: np.ndarray, width: int, height: int) -> np.ndarray:
    """A grey array at another size; each new pixel is the mean over the area that it covers."""
    return shares(values.shape[0], height) @ values.astype(float) @ shares(values.shape[1], width).T


def grey_values(found: DataFrame, width: int = 9, height: int = 8) -> DataFrame:
    """(file, values, error) of pictures: grey values at another size by rows, null with an error for broken files.

    With 9 x 8 values, ``difference_hash(values, row=9)`` is the hash of a picture.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            _, w, h, channels, _ = [c.to_pylist() if k < 4 else None for k, c in enumerate(batch.columns[:5])]
            rows = [
                np.rint(area_mean(png.grey(pixels(d.as_buffer(), a, b, c)), width, height)).astype(np.int32).ravel().tolist() if d.is_valid else None
                for a, b, c, d in zip(w, h, channels, batch.column(4), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32())), batch.column(5)], ["file", "values", "error"])

    return found.select("file", "width", "height", "channels", "data", "error").mapInArrow(run, "file string, values array<int>, error string")


def rasters(found: DataFrame) -> DataFrame:
    """(image, width, height, raster) of pictures in RGB, three bytes a pixel, transparent ones on white; null for broken files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = []
            for w, h, c, d in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)], batch.column(4), strict=True):
                made.append(on_white(pixels(d.as_buffer(), w, h, c)).tobytes() if d.is_valid else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], ["image", "width", "height", "raster"])

    return found.select("file", "width", "height", "channels", "data").mapInArrow(run, "image string, width int, height int, raster binary")


def colours(rasters_: DataFrame) -> DataFrame:
    """(image, y, x, r, g, b) of every pixel of pictures (image, width, raster of three bytes a pixel); a null raster has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            held, size = [], 0
            for k, (width, raster) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if raster.is_valid:
                    values = np.frombuffer(raster.as_buffer(), np.uint8).reshape(-1, 3).astype(np.int32)
                    at = np.arange(len(values), dtype=np.int32)
                    held.append([np.full(len(at), k, np.int32), at // np.int32(width), at % np.int32(width), *values.T])
                    size += len(at)
                if held and (size >= PIXELS_AT_ONCE or k == batch.num_rows - 1):
                    owner, *columns = [pa.array(np.concatenate(c)) for c in zip(*held, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *columns], ["image", "y", "x", "r", "g", "b"])
                    held, size = [], 0

    kind = dict(rasters_.dtypes)["image"]
    return rasters_.select("image", "width", "raster").mapInArrow(run, f"image {kind}, y int, x int, r int, g int, b int")


def on_white(values: np.ndarray) -> np.ndarray:
    """The RGB array of a picture of any channels."""
    if values.ndim == 2:
        return np.repeat(values[..., None], 3, 2)
    if values.shape[2] == 3:
        return values
    alpha = values[..., 3:].astype(int)
    return ((values[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)
