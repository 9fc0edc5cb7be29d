"""Histograms of frames and the filter of meaningless frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.functions import color, vec

BINS, CHANNELS, MAX_STD = 16, 3, 0.23


def from_long(pixels: DataFrame, value: Column, bins: int = BINS, width: int = 16, keys: tuple[str, ...] = ("video_id", "frame_id"), channel: str | None = None, channels: int = 1) -> DataFrame:
    """Dense histograms from one row a pixel: ``keys, n_pixels, hist``. Bin: value div ``width``; values outside are dropped.

    One hash aggregate with a partial sum for each bin, and no join to fill empty bins."""
    place = F.floor(value / width) + (F.col(channel) * bins if channel else 0)
    counts = [F.count(F.when(place == k, 1)).cast("double") for k in range(bins * channels)]
    return pixels.groupBy(*keys).agg(F.count("*").alias("n_pixels"), F.array(*counts).alias("hist"))


def from_text(df: DataFrame, text: str, bins: int = BINS) -> DataFrame:
    """``df`` without its text column, with ``n_pixels`` and ``hist`` of the text's characters as pixels:
    bin = least(code point, 255) div 16. Null texts have nulls.

    Narrow: Arrow batches, counted 4 MB of text at a time. (Sixteen counts of character classes in SQL take ten
    times as long, and exploding characters shuffles.)"""
    kept = [c for c in df.columns if c != text]
    narrow = df.select(*kept, text)
    kinds = "".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}, " for c in kept)

    def count(texts: list[str]) -> np.ndarray:
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        place = np.minimum(codes, 255).astype(np.int64) // (256 // bins)
        place += np.repeat(np.arange(len(texts)) * bins, np.fromiter(map(len, texts), np.int64, len(texts)))
        return np.bincount(place, minlength=len(texts) * bins).reshape(-1, bins).astype(float)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(kept)).to_pylist()
            full, held, size, parts = [t or "" for t in texts], [], 0, []
            for t in full:
                held.append(t)
                size += len(t)
                if size >= 1 << 20:
                    parts.append(count(held))
                    held, size = [], 0
            parts.append(count(held) if held else np.zeros((0, bins)))
            hist = np.concatenate(parts)
            there = np.array([t is not None for t in texts], bool)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(hist.ravel()), bins).cast(pa.list_(pa.float64()))
            none = pa.nulls(len(texts), flat.type)
            mask = pa.array(there)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pc.if_else(mask, pa.array([len(t) for t in full], pa.int64()), None), pc.if_else(mask, flat, none)], [*kept, "n_pixels", "hist"])

    return narrow.mapInArrow(scan, f"{kinds}n_pixels long, hist array<double>")


def image_features(images: DataFrame, space: str = "rgb", bins: int = BINS, keys: tuple[str, ...] = ("video_id", "frame_id")) -> DataFrame:
    """``keys, n_pixels, hist, gray_var`` from frames with ``height, width, data`` (interleaved BGR bytes).

    hist: ``3 * bins`` counts, channel after channel: R G B, or H S V for space ``hsv``. gray_var: population variance of
    the gray levels. Empty or null images have null features. Arrow batches in, one row a frame out."""
    names = [*keys, "height", "width", "data"]
    narrow = images.select(*names)
    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, hists, variances = [], [], []
            for h, w, data in zip(*(b.column(len(keys) + k).to_pylist() for k in range(3)), strict=True):
                if not data:
                    count.append(0), hists.append(None), variances.append(None)
                    continue
                bgr = color.pixels(data, h, w)
                planes = color.hsv_image(bgr) if space == "hsv" else bgr[..., ::-1]
                counts = [np.bincount(planes[..., k].ravel() // (256 // bins), minlength=bins) for k in range(CHANNELS)]
                count.append(h * w), hists.append(np.concatenate(counts).astype(float).tolist()), variances.append(float(color.gray_image(bgr).var()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), pa.array(count, pa.int64()), pa.array(hists, pa.list_(pa.float64())), pa.array(variances, pa.float64())], [*keys, "n_pixels", "hist", "gray_var"])

    return narrow.mapInArrow(scan, f"{kinds}, n_pixels long, hist array<double>, gray_var double")


def hue_histogram(hist_h: Column) -> Column:
    """Of 180 hue counts, 16 bins of width 16; only the first 12 can be filled."""
    return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda k: F.when(k * 16 < F.size(hist_h), vec.total(F.slice(hist_h, k * 16 + 1, F.lit(16)))).otherwise(0.0))


def fold(hist: Column, by: int = 16) -> Column:
    """Sums of ``by`` neighbouring bins: 256 bins to 16."""
    return F.transform(F.sequence(F.lit(0), (F.size(hist) / by).cast("int") - 1), lambda k: vec.total(F.slice(hist, k * by + 1, F.lit(by))))


def value_channel(hist: Column, bins: int = BINS) -> Column:
    """The V bins of an H, S, V histogram."""
    return F.slice(hist, 2 * bins + 1, bins)


def with_norm(features: DataFrame) -> DataFrame:
    return features.withColumn("hist_norm", vec.normalise("hist", "n_pixels"))


def spread_of(hist: str, kind: str) -> Column:
    """How uneven a normalised histogram is: ``std`` (population), ``fixed_mean`` (from 1/16, over 16 whatever the bins) or
    ``root_squares``."""
    if kind == "std":
        return vec.std(hist)
    return fixed_mean_std(F.col(hist)) if kind == "fixed_mean" else F.sqrt(vec.total(vec.squared_deviation(hist, 0.0)))


def meaningful(features: DataFrame, max_std: float = MAX_STD, kind: str = "std", hist: str = "hist_norm") -> DataFrame:
    """Frames whose normalised histogram is spread: standard deviation under ``max_std``, or another ``kind`` of ``spread_of`` that is
    not over it. Nulls are dropped."""
    std = F.col("std")
    return features.withColumn("std", spread_of(hist, kind)).filter(std < max_std if kind == "std" else std <= max_std)


def fixed_mean_std(hist_norm: Column, center: float = 1 / 16, n: int = 16) -> Column:
    """Root of the mean squared deviation from a fixed mean, over ``n`` whatever the number of bins."""
    return F.sqrt(vec.total(vec.squared_deviation(hist_norm, center)) / n)


def gray_statistics(pixels: DataFrame, value: Column, keys: tuple[str, ...] = ("video_id", "frame_id")) -> DataFrame:
    """Mean, population variance and sample variance of gray levels, by frame, from one row a pixel."""
    return pixels.groupBy(*keys).agg(F.count("*").alias("n_pixels"), F.avg(value).alias("gray_mean"), F.var_pop(value).alias("gray_var"), F.var_samp(value).alias("gray_var_samp"))
