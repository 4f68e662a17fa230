"""Masks as runs: rows (key columns, y, x1, x2) of covered pixels, x2 excluded.

A mask costs its runs, not its pixels. Set operations sweep over the ends of the runs of a line of
pixels; what meets as one row is a band of lines of one image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from .masks import COVERED, sliced, to_array


#: Lines of pixels of one key that meet in a task, and lines that are swept at once.
BAND, AT_ONCE = 1024, 1 << 18


def _swept(shapes: DataFrame, keys: Sequence[str], covered: Callable[[np.ndarray], np.ndarray], side: Column | None = None, once: bool = True) -> DataFrame:
    """Longest runs (keys, y, x1, x2) where ``covered`` holds of the sum of the sides over a pixel; it is not to hold of 0.

    ``shapes`` (keys, y1, y2, x1, x2) are boxes, or runs where y2 is y1 + 1; ``side`` is a small positive number, 1 where it is
    missing. With ``once`` a side counts once over a pixel, however many of its shapes are there. Shapes of a key that
    follow each other are packed into one row before they are dealt, and BAND lines of a key are swept as one row.
    """
    band = lambda y: F.floor(y / BAND)
    bands = F.explode(F.sequence(band(F.col("y1")), band(F.col("y2") - 1)))
    rows = shapes.where("x1 < x2 AND y1 < y2").select(*keys, bands.alias("_band"), "y1", "y2", "x1", "x2", (F.lit(1) if side is None else side).cast("int").alias("_side"))
    low, high = F.greatest("y1", F.col("_band") * BAND), F.least("y2", (F.col("_band") + 1) * BAND)
    own = [*keys, "_band"]
    rows = rows.select(*own, low.alias("y1"), high.alias("y2"), "x1", "x2", "_side")
    types = dict(shapes.select(F.col("y1").alias("y"), "x1", "x2").dtypes)
    number = np.int32 if set(types.values()) <= {"int", "smallint", "tinyint"} else np.int64
    n = len(own)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                first = np.flatnonzero(starts(batch.columns[:n]))
                table = np.stack([c.to_numpy().astype(number) for c in batch.columns[n:]], 1)
                packed = [t.tobytes() for t in np.split(table, first[1:])]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(first)) for c in batch.columns[:n]], pa.array(packed, pa.binary())], [*own, "packed"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(n)
            groups = [np.frombuffer(b"".join(g), number).reshape(-1, 5).astype(np.int64) for g in held.to_pylist()]
            lines = np.cumsum([int((g[:, 1] - g[:, 0]).sum()) for g in groups])
            at = 0
            while at < len(groups):
                to = max(at + 1, int(np.searchsorted(lines, (lines[at - 1] if at else 0) + AT_ONCE, "right")))
                owner = np.repeat(np.arange(at, to), [len(g) for g in groups[at:to]])
                found = swept(owner, *np.concatenate(groups[at:to]).T, covered, once)
                columns = [pa.array(c).cast(kind) for c, kind in zip(found[1:], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(found[0])) for c in batch.columns[: n - 1]], *columns], [*keys, "y", "x1", "x2"])
                at = to

    schema = rows.select(*own).schema
    known = {c: f"`{c}` {schema[c].dataType.simpleString()}" for c in own}
    kinds = [{"int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(t, pa.int64()) for t in types.values()]
    kept = ", ".join(f"{c} {t if t in ('int', 'smallint', 'tinyint') else 'bigint'}" for c, t in types.items())
    packed = rows.mapInArrow(pack, ", ".join([*known.values(), "packed binary"]))
    dealt = packed.groupBy(*own).agg(F.collect_list("packed").alias("packed"))
    return dealt.mapInArrow(sweep, ", ".join([*[known[k] for k in keys], kept]))


def starts(columns: Sequence[pa.Array]) -> np.ndarray:
    """Whether a row differs from the one before it in any column."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        there = c.is_valid().to_numpy(zero_copy_only=False)
        new[1:] |= there[1:] != there[:-1]
        if pa.types.is_struct(c.type):
            new |= starts(c.flatten()) if c.type.num_fields else False
        elif pa.types.is_nested(c.type):
            new[:] = True
        else:
            new[1:] |= pc.fill_null(pc.not_equal(c.slice(0, len(c) - 1), c.slice(1)), False).to_numpy(zero_copy_only=False)
    return new


def swept(owner: np.ndarray, y1: np.ndarray, y2: np.ndarray, x1: np.ndarray, x2: np.ndarray, side: np.ndarray, covered: Callable[[np.ndarray], np.ndarray], once: bool = True) -> tuple[np.ndarray, ...]:
    """owner, y, x1 and x2 of the longest runs where ``covered`` holds of the sum of the sides of the boxes over a pixel."""
    high = y2 - y1
    at = np.repeat(np.arange(len(high)), high)
    y = y1[at] + np.arange(len(at)) - np.repeat(np.cumsum(high) - high, high)
    lines, y = np.unique(y, return_inverse=True)
    row, x1, x2, side = owner[at] * len(lines) + y, x1[at], x2[at], side[at]
    if once:
        most = int(side.max(initial=0)) + 1
        line, x1, x2 = _covered(row * most + side, x1, x2, np.ones_like(row), lambda n: n > 0)
        row, side = np.divmod(line, most)
    row, x1, x2 = _covered(row, x1, x2, side, covered)
    return row // max(1, len(lines)), lines[row % max(1, len(lines))] if len(lines) else row, x1, x2


def _covered(row: np.ndarray, x1: np.ndarray, x2: np.ndarray, weight: np.ndarray, covered: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, ...]:
    """row, x1 and x2 of the longest runs where ``covered`` holds of the sum of the weights over a pixel."""
    row, x, weight = np.concatenate([row, row]), np.concatenate([x1, x2]), np.concatenate([weight, -weight])
    order = np.lexsort((x, row))
    row, x = row[order], x[order]
    # The ends at one place count together, and the weights of a row add up to 0.
    last = np.append((np.diff(row) != 0) | (np.diff(x) != 0), True)[: len(row)]
    row, x, on = row[last], x[last], covered(np.cumsum(weight[order])[last])
    edges = np.flatnonzero(np.diff(on, prepend=False))
    return row[edges[::2]], x[edges[::2]], x[edges[1::2]]


def _lines(runs: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    """Runs as boxes of one line."""
    return runs.select(*keys, F.col("y").alias("y1"), (F.col("y") + 1).alias("y2"), "x1", "x2", *more)


def union(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The runs of each key's pixels, each pixel once; runs that touch are one."""
    return _swept(_lines(runs, keys), keys, lambda n: n > 0)


def intersection(runs: DataFrame, keys: Sequence[str], mask: str, masks: int) -> DataFrame:
    """Pixels that ``masks`` different masks of a key have."""
    return _swept(_lines(union(runs, [*keys, mask]), keys), keys, lambda n: n == masks, once=False)


def _two_sided(one: DataFrame, other: DataFrame, keys: Sequence[str], covered: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pixels of whose sides ``covered`` holds: 1 is on ``one`` only, 2 on ``other`` only, 3 on both."""
    tagged = [_lines(runs, keys).withColumn("side", F.lit(k)) for k, runs in ((1, one), (2, other))]
    return _swept(tagged[0].unionByName(tagged[1]), keys, covered, F.col("side"))


def without(runs: DataFrame, less: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixels of ``runs`` that ``less`` does not have."""
    return _two_sided(runs, less, keys, lambda n: n == 1)


def inverted(runs: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pixels within (keys, width, height) of ``sizes`` that a mask does not have."""
    whole = sizes.where("width > 0 AND height > 0").select(*keys, F.lit(0).alias("y1"), F.col("height").alias("y2"), F.lit(0).alias("x1"), F.col("width").alias("x2"), F.lit(1).alias("side"))
    return _swept(whole.unionByName(_lines(runs, keys).withColumn("side", F.lit(2))), keys, lambda n: n == 1, F.col("side"))


def combine(drawn: DataFrame, existing: DataFrame, operation: str = "union", keys: Sequence[str] = ("image",)) -> DataFrame:
    """A mask from an annotation with an existing one.

    ``json_only`` and ``mask_only`` take one side; any other word but ``intersection`` is a union.
    """
    if operation in ("json_only", "mask_only"):
        return union(drawn if operation == "json_only" else existing, keys)
    return _two_sided(drawn, existing, keys, (lambda n: n == 3) if operation == "intersection" else (lambda n: n > 0))


def prompted(positive: DataFrame, negative: DataFrame, mode: str = "both", keys: Sequence[str] = ("image",)) -> DataFrame:
    """The mask of prompts: all positive ones without the negative ones, or one side by itself (``positive``, ``negative``)."""
    if mode not in ("both", "positive", "negative"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "both":
        return without(positive, negative, keys)
    return union(positive if mode == "positive" else negative, keys)


def of_boxes(boxes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs of (keys, x1, y1, x2, y2), upper edges excluded; overlapping boxes of a key once. Boxes are dealt, not their lines."""
    return _swept(boxes.select(*keys, "y1", "y2", "x1", "x2"), keys, lambda n: n > 0)


def of_rasters(rasters: DataFrame) -> DataFrame:
    """(mask_id, y, x1, x2) of rasters (mask_id, width, height, raster): pixels above COVERED; a null raster has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            owner, rows = [], []
            for k, (w, h, raster) in enumerate(zip(*[batch.column(j).to_pylist() for j in (1, 2)], batch.column(3), strict=True)):
                if raster.is_valid and w and h:
                    y, x1, x2 = row_runs(to_array(raster.as_buffer(), w, h) > COVERED)
                    owner.append(np.full(len(y), k))
                    rows.append((y, x1, x2))
            if rows:
                columns = [pa.array(np.concatenate(c).astype(np.int32)) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(owner))), *columns], ["mask_id", "y", "x1", "x2"])

    kind = dict(rasters.dtypes)["mask_id"]
    return rasters.select("mask_id", "width", "height", "raster").mapInArrow(run, f"mask_id {kind}, y int, x1 int, x2 int")


def row_runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, x1 and x2 of the runs of a boolean array's rows."""
    step = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    y, x1 = np.nonzero(step == 1)
    return y, x1, np.nonzero(step == -1)[1]


def rasterized(runs: DataFrame, key: str, width: Column, height: Column) -> DataFrame:
    """(mask_id, width, height, raster) of runs; what lies outside the size is cut off."""
    one = F.struct(F.col("y").cast("int").alias("y"), F.col("x1").cast("int").alias("x1"), F.col("x2").cast("int").alias("x2"))
    rows = runs.groupBy(F.col(key).alias("mask_id"), width.cast("int").alias("width"), height.cast("int").alias("height")).agg(F.collect_list(one).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own, ends = batch.column(3).flatten(), np.cumsum(pc.list_value_length(batch.column(3)).to_numpy())
            ys, lows, highs = [own.field(c).to_numpy() for c in ("y", "x1", "x2")]
            made, at = [], 0
            for w, h, end in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), ends.tolist(), strict=True):
                raster = np.zeros((h, w), np.uint8)
                for y, x1, x2 in zip(ys[at:end].tolist(), lows[at:end].tolist(), highs[at:end].tolist(), strict=True):
                    if 0 <= y < h:
                        raster[y, max(0, x1) : max(0, x2)] = 255
                made.append(raster.tobytes())
                at = end
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.binary())], ["mask_id", "width", "height", "raster"])

    kind = dict(rows.dtypes)["mask_id"]
    return rows.mapInArrow(run, f"mask_id {kind}, width int, height int, raster binary")


def pixels(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, y, x, v) of runs that do not overlap, 255 each, for what needs single pixels."""
    x = F.explode(F.sequence(F.col("x1"), F.col("x2") - 1))
    return runs.where("x1 < x2").select(*keys, "y", x.alias("x"), F.lit(255).alias("v"))


def areas(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pixels) of runs that do not overlap."""
    return runs.groupBy(*keys).agg(F.sum(F.col("x2") - F.col("x1")).alias("pixels"))


def matches(runs: DataFrame, people: DataFrame) -> DataFrame:
    """(image, part, person_id, score) of part masks (image, part, y, x1, x2) with the persons' boxes of their image.

    As ``boxes.box_matches``, but overlap, area and centre are those of the mask. A run meets the
    persons of its image and folds to a row a part and person before anything is shuffled again.
    """
    q, n = F.col("q"), F.col("x2") - F.col("x1")
    rows = union(runs, ["image", "part"]).join(people.select("image", "person_id", F.col("bbox").alias("q")), "image")
    across = F.ceil(F.least(F.col("x2").cast("double"), q["x2"].cast("double"))) - F.ceil(F.greatest(F.col("x1").cast("double"), q["x1"].cast("double")))
    inside = F.when((F.col("y") >= q["y1"]) & (F.col("y") < q["y2"]), F.greatest(across, F.lit(0))).otherwise(F.lit(0))
    sums = rows.groupBy("image", "part", "person_id", "q").agg(
        F.sum(inside).alias("shared"), F.sum(n).alias("size"), F.sum(n * (F.col("x1") + F.col("x2") - 1)).alias("sx"), F.sum(n * F.col("y")).alias("sy")
    )
    cx, cy = F.col("sx") / (2 * F.col("size")), F.col("sy") / F.col("size")
    gap = F.sqrt(F.pow(cx - (q["x1"] + q["x2"]) / 2, 2) + F.pow(cy - (q["y1"] + q["y2"]) / 2, 2))
    across = F.sqrt(F.pow(q["x2"] - q["x1"], 2) + F.pow(q["y2"] - q["y1"], 2))
    distance = F.when(across > 0, gap / across).otherwise(F.lit(float("inf")))
    score = geometry.match_score(F.col("shared"), F.col("size"), geometry.area(q), distance)
    return sums.select("image", "part", "person_id", score.alias("score"))
