"""Boxes and scores as column expressions. A box is struct(x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def overlap(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    width = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    height = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Shared area by joint area, 0.0 where that is nothing."""
    joint = area(a) + area(b) - overlap(a, b)
    return F.when(joint > 0, overlap(a, b) / joint).otherwise(F.lit(0.0))


def clamp(b: Column, width: Column, height: Column) -> Column:
    """Inside the canvas and at least one pixel wide and high."""
    x1 = F.greatest(F.lit(0), F.least(b["x1"], width - 1))
    y1 = F.greatest(F.lit(0), F.least(b["y1"], height - 1))
    return box(x1, y1, F.greatest(x1 + 1, F.least(b["x2"], width)), F.greatest(y1 + 1, F.least(b["y2"], height)))


def shrink(b: Column, ratio: float | Column) -> Column:
    """Towards the centre, rounded half to even, at least one pixel; ratios from 1 change nothing, nor does a null one."""
    if isinstance(ratio, Column):
        return F.when(ratio < 1, _shrunk(b, ratio)).otherwise(b)
    return b if ratio >= 1 else _shrunk(b, F.lit(float(ratio)))


def _shrunk(b: Column, ratio: Column) -> Column:
    def ends(low: Column, high: Column) -> tuple[Column, Column]:
        middle, half = (low + high) / 2, (high - low) * ratio / 2
        a, z = (F.bround(middle + s * half).cast("int") for s in (-1, 1))
        return a, F.greatest(z, a + 1)

    (x1, x2), (y1, y2) = ends(b["x1"], b["x2"]), ends(b["y1"], b["y2"])
    return box(x1, y1, x2, y2)


def from_centre(cx: Column, cy: Column, w: Column, h: Column, scale: Column, pad_w: Column, pad_h: Column, width: Column, height: Column, cut_first: bool) -> Column:
    """A letterboxed model's centre box on the original image, in whole pixels.

    ``cut_first`` truncates before it clamps; else edges are clamped as fractions first.
    """

    def edge(centre: Column, size: Column, sign: int, pad: Column, most: Column) -> Column:
        at = (centre + sign * size / 2 - pad) / scale
        if cut_first:
            at = at.cast("int")
            return F.greatest(F.lit(0), at) if sign < 0 else F.least(most, at)
        return F.greatest(F.lit(0.0), F.least(most.cast("double"), at)).cast("int")

    return box(
        edge(cx, w, -1, pad_w, width), edge(cy, h, -1, pad_h, height), edge(cx, w, 1, pad_w, width), edge(cy, h, 1, pad_h, height)
    )


def sigmoid(x: Column) -> Column:
    """Logistic function of a logit within 30; NaN counts as 0, the infinities as 1 and 0."""
    clean = F.when(F.isnan(x), 0.0).when(x == float("inf"), 1.0).when(x == float("-inf"), 0.0).otherwise(x)
    return 1 / (1 + F.exp(-F.greatest(F.least(clean, F.lit(30.0)), F.lit(-30.0))))


def probability(score: Column) -> Column:
    """A score that may still be a logit: above 1 it is."""
    return F.when(score > 1, 1 / (1 + F.exp(-score))).otherwise(score)


def match_score(shared: Column, part_area: Column, box_area: Column, distance: Column) -> Column:
    """How well a part fits a person: 0.4 IoU, 0.3 nearness of centres, 0.3 containment."""
    joint = part_area + box_area - shared
    fit = F.when(joint > 0, shared / joint).otherwise(0.0)
    inside = F.when(part_area > 0, shared / part_area).otherwise(0.0)
    return 0.4 * fit + 0.3 * F.greatest(F.lit(0.0), 1 - distance) + 0.3 * inside
