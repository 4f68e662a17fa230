"""Masks from pose keypoints: limbs, torso, feet and neck."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .masks import draw_line, fill_polygon, smooth

#: Places of keypoints, and the parts drawn from them.
KEYPOINTS = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow",
    "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle",
    "right_ankle",
)
AT = {name: k for k, name in enumerate(KEYPOINTS)}
LIMBS = {
    "arms": (("left_shoulder", "left_elbow"), ("left_elbow", "left_wrist"), ("right_shoulder", "right_elbow"), ("right_elbow", "right_wrist")),
    "legs": (("left_hip", "left_knee"), ("left_knee", "left_ankle"), ("right_hip", "right_knee"), ("right_knee", "right_ankle")),
}
POLYGONS = {"torso": ("left_shoulder", "right_shoulder", "right_hip", "left_hip"), "neck": ("nose", "left_shoulder", "right_shoulder")}
THICKNESS, LEAST_THICKNESS, FOOT, LEAST_FOOT = 20, 8, 30, 12


def draw(part: str, points: dict[int, tuple[int, int, float]], width: int, height: int, sure: float) -> tuple[np.ndarray, int]:
    """Mask of one person's part and how many pieces it has; keypoints below ``sure`` are missing."""
    mask, pieces = np.zeros((height, width), np.uint8), 0
    at = {n: points[k][:2] for n, k in AT.items() if k in points and points[k][2] >= sure}
    scale = max(width, height) / 1000
    for a, b in LIMBS.get(part, ()):
        if a in at and b in at:
            draw_line(mask, at[a], at[b], max(LEAST_THICKNESS, int(THICKNESS * scale)))
            pieces += 1
    corners = POLYGONS.get(part, ())
    if corners and all(n in at for n in corners):
        mask |= fill_polygon([at[n] for n in corners], width, height)
        pieces += 1
    if part == "feet":
        for n in ("left_ankle", "right_ankle"):
            if n in at:
                draw_line(mask, at[n], at[n], 2 * max(LEAST_FOOT, int(FOOT * scale)))
                pieces += 1
    return mask, pieces


def skeleton_masks(keypoints: DataFrame, part: str, sure: float = 0.3, soft: bool = True) -> DataFrame:
    """(image, width, height, raster, pieces) of a part over all persons of each image, its edges smoothed if ``soft``.

    ``keypoints``: (image, width, height, person, idx, x, y, conf); an image's keypoints are a
    few hundred rows at most, which bounds a group.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        width, height = int(rows["width"].iloc[0]), int(rows["height"].iloc[0])
        mask, pieces = np.zeros((height, width), np.uint8), 0
        for _, own in rows.groupby("person"):
            points = {int(i): (int(x), int(y), float(c)) for i, x, y, c in zip(own["idx"], own["x"], own["y"], own["conf"], strict=True)}
            one, n = draw(part, points, width, height, sure)
            mask, pieces = np.maximum(mask, one), pieces + n
        if pieces and soft:
            thick = max(LEAST_THICKNESS, int(THICKNESS * max(width, height) / 1000))
            mask = smooth(mask, max(3, thick // 2) | 1)
        return pd.DataFrame({"image": rows["image"].iloc[:1], "width": [width], "height": [height], "raster": [mask.tobytes()], "pieces": [pieces]})

    kind = dict(keypoints.dtypes)["image"]
    return keypoints.groupBy("image").applyInPandas(run, f"image {kind}, width int, height int, raster binary, pieces int")
