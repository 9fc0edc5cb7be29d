"""Filters of a finished summary, and its joins with frames and videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.functions import vec
from framelode.operators.sequence import FRAME, VIDEO, by_frame

HUE_LIMIT, CORRELATION, MIN_VARIANCE = 0.5, 0.5, 700.0


def pair_filter(frames: DataFrame, hue: str = "hue_norm", rgb: str = "rgb", pixels: str | None = "pixels", hue_limit: float = HUE_LIMIT, correlation: float = CORRELATION, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """Summary frames without those that look like the next one: hue distance under ``hue_limit``, and colour
    histogram and pixels correlated over ``correlation``. Missing or constant vectors do not correlate."""
    w = by_frame(video, frame)

    def alike(c: str) -> Column:
        return vec.pearson(F.col(c), F.lead(c).over(w)) > correlation

    same = (vec.l1(F.col(hue), F.lead(hue).over(w)) < hue_limit) & alike(rgb)
    if pixels:
        same = same & alike(pixels)
    return frames.withColumn("__same", F.coalesce(same, F.lit(False))).filter(~F.col("__same")).drop("__same")


def low_variance_filter(frames: DataFrame, variance: str = "gray_var", least: float = MIN_VARIANCE) -> DataFrame:
    """Frames whose gray variance is over ``least``."""
    return frames.filter(F.col(variance) > least)


def summary_frames(frames: DataFrame, keyframes: DataFrame, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """The frames that a summary names: a left semi join."""
    return frames.join(keyframes.select(video, frame), [video, frame], "left_semi")


def unfinished(videos: DataFrame, summaries: DataFrame, video: str = VIDEO) -> DataFrame:
    """Videos that have no summary yet: a left anti join."""
    return videos.join(summaries.select(video).distinct(), video, "left_anti")


def short_videos(videos: DataFrame, most: int = 5, length: str = "length") -> DataFrame:
    return videos.filter(F.col(length) <= most)
