"""Colour conversions: column expressions for single pixels and numpy forms for whole images.

HSV is the 8-bit form with hue in 0..179, saturation and value in 0..255. Gray is
0.299 R + 0.587 G + 0.114 B, rounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(r: Column, g: Column, b: Column) -> Column:
    return F.round(r * 0.299 + g * 0.587 + b * 0.114).cast("int")


def hsv(r: Column, g: Column, b: Column) -> Column:
    """``struct(h, s, v)``. A pixel without colour has hue and saturation 0."""
    top, low = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    span = top - low
    s = F.when(top > 0, F.round(span * 255 / F.when(top > 0, top))).otherwise(0)
    safe = F.when(span > 0, span)
    turn = F.when(span == 0, 0.0).when(top == r, (g - b) * 60 / safe).when(top == g, 120 + (b - r) * 60 / safe).otherwise(240 + (r - g) * 60 / safe)
    degrees = F.when(turn < 0, turn + 360).otherwise(turn)
    return F.struct((F.round(degrees / 2) % 180).cast("int").alias("h"), s.cast("int").alias("s"), top.cast("int").alias("v"))


def pixels(data: bytes, height: int, width: int, channels: int = 3) -> np.ndarray:
    """Image bytes, interleaved as Spark's image source has them (blue, green, red), as an array."""
    return np.frombuffer(data, np.uint8).reshape(height, width, channels)


def gray_image(bgr: np.ndarray) -> np.ndarray:
    """The gray levels of ``gray``, with its order of terms, so that halves round alike."""
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    return np.floor(r * 0.299 + g * 0.587 + b * 0.114 + 0.5)


def hsv_image(bgr: np.ndarray) -> np.ndarray:
    """Hue, saturation and value planes of a BGR image, stacked last."""
    b, g, r = (bgr[..., k].astype(np.float64) for k in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    span = top - low
    s = np.where(top > 0, np.floor(span * 255 / np.where(top > 0, top, 1) + 0.5), 0)
    safe = np.where(span > 0, span, 1)
    turn = np.where(top == r, (g - b) * 60 / safe, np.where(top == g, 120 + (b - r) * 60 / safe, 240 + (r - g) * 60 / safe))
    turn = np.where(span > 0, np.where(turn < 0, turn + 360, turn), 0)
    return np.stack([np.floor(turn / 2 + 0.5) % 180, s, top], axis=-1).astype(np.uint8)


def planar(image: np.ndarray) -> np.ndarray:
    """Planes one after another instead of interleaved channels."""
    return np.moveaxis(image, -1, 0)
