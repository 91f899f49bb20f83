"""Pose detections → frame rows.

Input: ``video_id, pos_msec, width, height, persons`` where ``persons`` is
``array<array<struct<x,y>>>`` of normalised keypoints (one inner array per
detected person, 17 keypoints in the fixed order of ``config.KEYPOINTS``).
Everything is a row-local projection, so it runs at scan speed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYPOINTS


def frame_time(ms_col: str = "pos_msec"):
    """Frame timestamp in seconds, 2 decimals."""
    return F.round(F.col(ms_col) / 1000.0, 2)


def keypoints_to_pixels(det: DataFrame, keypoints: Sequence[str] = KEYPOINTS) -> DataFrame:
    """First detected person, normalised → pixel coordinates by
    truncation; NULL for every keypoint when nobody is detected."""
    first = F.when(F.size("persons") > 0, F.element_at("persons", 1))
    cols = [F.col("video_id"), frame_time().alias("time")]
    for i, name in enumerate(keypoints):
        pt = first[i]
        cols.append((pt["x"] * F.col("width")).cast("int").alias(f"{name}_x"))
        cols.append((pt["y"] * F.col("height")).cast("int").alias(f"{name}_y"))
    return det.select(*cols)


def origin_distance(px: DataFrame, keypoints: Sequence[str] = KEYPOINTS) -> DataFrame:
    """Euclidean distance of each keypoint from the image origin
    (NULL-propagating)."""
    return px.withColumns({f"{k}_distance": F.hypot(F.col(f"{k}_x").cast("double"),
                                                     F.col(f"{k}_y").cast("double"))
                           for k in keypoints})


def detections_to_frames(det: DataFrame, keypoints: Sequence[str] = KEYPOINTS) -> DataFrame:
    """S6–S8 composed: the frame table of one or many videos."""
    return origin_distance(keypoints_to_pixels(det, keypoints), keypoints)
