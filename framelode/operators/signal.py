"""Signals along a frame sequence: distances, filters, transitions, shots.

Row-bounded windows come from functions of a ``WindowSpec`` and run by chunk (``sequence.chunked``), and so does the smoothing
spline, whose far neighbours do not count. Runs of rising and falling frames, and of frames without effects, are gaps and
islands over frame places. Only the merge of intervals carries state along a whole video: it has one narrow row an interval.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framelode.functions import vec
from framelode.operators.sequence import FRAME, SPAN, VIDEO, chunked, chunks, positions, with_video
from framelode.scratch import written

FADE, CUT, CUT_REACH, SCENE_REACH, MIN_SHOT = 0.1, 0.4, 20, 24, 10
SMOOTH, GAP, CAP = 0.05, 10, 90
REACH = 512  # frames beyond which a frame does not move the spline: its weight falls by half in under four frames
MIN_DISSOLVE, DISSOLVE_LEVEL, DISSOLVE_SHAPE = 10, 0.1, 0.7


def consecutive(w: WindowSpec, hist: str, metric: str = "l2") -> Column:
    """Distance to the previous frame; null for a video's first one. Metrics: l1, l2, cosine."""
    f = vec.DISTANCES.get(metric, vec.cosine_dissimilarity)
    return f(F.col(hist), F.lag(hist).over(w))


def dissimilarity(w: WindowSpec, hist: str) -> Column:
    """Cosine dissimilarity to the next frame; 0 for a video's first and last frame and where a vector is zero."""
    d = vec.cosine_dissimilarity(F.col(hist), F.lead(hist).over(w))
    return F.when(F.lag(F.lit(1)).over(w).isNull(), 0.0).otherwise(F.coalesce(d, F.lit(0.0)))


def neighbourhood_max(w: WindowSpec, x: str, reach: int) -> Column:
    """(x - m) / x where x is over m, else 0; m: the largest of ``reach`` values before and ``reach - 1`` after, none counting as 0."""
    left = F.coalesce(F.max(x).over(w.rowsBetween(-reach, -1)), F.lit(0.0))
    right = F.coalesce(F.max(x).over(w.rowsBetween(1, reach - 1)), F.lit(0.0)) if reach > 1 else F.lit(0.0)
    m = F.greatest(left, right, F.lit(0.0))
    return F.when(F.col(x) > m, (F.col(x) - m) / F.col(x)).otherwise(0.0)


def convolve(w: WindowSpec, x: str, kernel: tuple[int, ...]) -> Column:
    """Convolution of the same length with kernels (1, -1) and (1, -2, 1); 0 beyond the ends."""
    after = F.lead(x, 1, 0.0).over(w)
    if kernel == (1, -1):
        return after - F.col(x)
    if kernel == (1, -2, 1):
        return after - 2 * F.col(x) + F.lag(x, 1, 0.0).over(w)
    raise ValueError(f"no convolution of the same length for kernel {kernel}")


def difference(w: WindowSpec, x: str) -> Column:
    return F.col(x) - F.lag(x).over(w)


def median5(w: WindowSpec, x: str) -> Column:
    """Median of a frame's value and the four after it; 0 for the last four frames."""
    five = w.rowsBetween(0, 4)
    return F.when(F.count(F.lit(1)).over(five) == 5, F.percentile(x, F.lit(0.5)).over(five)).otherwise(0.0)


def by_maximum(signals: DataFrame, x: str, out: str, video: str = VIDEO) -> DataFrame:
    """``signals`` with ``out``: x over its video's maximum (0 where that is 0)."""
    top = signals.groupBy(video).agg(F.max(x).alias("__top"))
    return with_video(signals, top, video).withColumn(out, F.when(F.col("__top") != 0, F.col(x) / F.col("__top")).otherwise(0.0)).drop("__top")


def fade(ratio: Column, limit: float = FADE) -> Column:
    """0 in a fade (variance under a tenth of the video's largest), else 1."""
    return F.when(ratio < limit, 0).otherwise(1)


def cut(filtered: Column, limit: float = CUT) -> Column:
    """0 at a cut, else 1."""
    return F.when(filtered > limit, 0).otherwise(1)


def spline(y: np.ndarray, p: float = SMOOTH) -> np.ndarray:
    """Cubic smoothing spline of evenly spaced values: minimises p |y - f|^2 + (1 - p) |f''|^2, exactly.

    Solves (6 (1 - p) Q'Q + p R) u = Q'y, five bands, by LDL' elimination in linear time."""
    n = len(y)
    if n < 3 or p >= 1:
        return y.astype(float).copy()
    a, m = 6 * (1 - p), n - 2
    d, e, f = np.full(m, 6 * a + 4 * p), np.full(m, -4 * a + p), np.full(m, a)
    u = np.diff(y, 2).astype(float)
    low1, low2 = np.zeros(m), np.zeros(m)
    for i in range(m):
        if i > 1:
            low2[i] = f[i] / d[i - 2]
            d[i] -= low2[i] * f[i]
        if i:
            cross = e[i] - (low2[i] * d[i - 2] * low1[i - 1] if i > 1 else 0.0)
            low1[i] = cross / d[i - 1]
            d[i] -= low1[i] * cross
            u[i] -= low1[i] * u[i - 1]
        if i > 1:
            u[i] -= low2[i] * u[i - 2]
    u /= d
    for i in range(m - 2, -1, -1):
        u[i] -= low1[i + 1] * u[i + 1]
        if i + 2 < m:
            u[i] -= low2[i + 2] * u[i + 2]
    back = np.zeros(n)
    back[:m] += u
    back[1:-1] -= 2 * u
    back[2:] += u
    return y - a * back


def smooth(signals: DataFrame, x: str, out: str = "smooth", p: float = SMOOTH, video: str = VIDEO, frame: str = FRAME, rows: int = SPAN, reach: int = REACH) -> DataFrame:
    """``video, frame, x, out`` (and ``pos``, if given): the smoothing spline of x along each video, nulls as 0.

    Chunk by chunk, each solved with ``reach`` frames more at both ends: a frame's weight falls geometrically with the distance,
    so that none is left from there."""
    kept = [video, frame, *(["pos"] if "pos" in signals.columns else []), x]
    narrow = signals.select(*kept[:-1], F.col(x).cast("double").alias(x))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        pdf[out] = spline(pdf[x].fillna(0.0).to_numpy(), p)
        return pdf[pdf["__own"] == pdf["__chunk"]][[*kept, out]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema)
    return chunks(narrow, reach, reach, video, frame, rows).groupBy(video, "__chunk").applyInPandas(run, f"{schema}, `{out}` double")


def slopes(smoothed: DataFrame, v: str, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``video, frame, pos, v, rise, bend, turn, fresh`` from ``video, frame, pos, v``.

    rise: the next value less this one; bend: the second difference; none counting as 0. turn: two frames of fall before this one
    and two of rise after it. fresh: the frame before does not rise."""

    def compute(w: WindowSpec) -> dict[str, Column]:
        def at(k: int) -> Column:
            return F.lead(v, k, 0.0).over(w) if k > 0 else F.lag(v, -k, 0.0).over(w) if k < 0 else F.col(v)

        def rise(k: int) -> Column:
            return at(k + 1) - at(k)

        turn = (rise(-2) < 0) & (rise(-1) < 0) & (rise(0) >= 0) & (rise(1) > 0) & (rise(2) > 0)
        inside = F.lag(F.lit(1), 2).over(w).isNotNull() & F.lead(F.lit(1), 2).over(w).isNotNull()
        return {"rise": rise(0), "bend": at(1) - 2 * at(0) + at(-1), "turn": turn & inside, "fresh": F.lag(F.lit(1), 1).over(w).isNull() | (rise(-1) <= 0)}

    return chunked(smoothed.select(video, frame, "pos", F.col(v).alias(v)), compute, 3, 3, video, frame)


def dissolve_spans(smoothed: DataFrame, v: str, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``video, start_frame, end_frame`` of dissolves in a smoothed signal ``video, frame, pos, v``: V shapes.

    A turn lies between a run of falling frames and a run of rising ones, both of which end inside the video. Its sides are
    the sharpest downward bends of the runs, the nearest to the turn on ties, or else the turn itself. They are
    over ``MIN_DISSOLVE`` frames apart, the turn's value is over ``DISSOLVE_LEVEL``, and the value in the middle is near a
    quarter of the sides' sum."""
    s = written(slopes(smoothed, v, video, frame), "slopes")
    side = F.struct("bend", "near", F.col("pos").alias("at"), F.col(v).alias("value"), F.col(frame).alias("id"))

    def runs(sign: int) -> DataFrame:
        """Runs of frames that fall (-1) or rise (1), with their sides."""
        own = positions(s.filter(F.col("rise") * sign > 0).withColumnRenamed("pos", "place"), video, frame).withColumn("run", F.col("place") - F.col("pos"))
        own = own.withColumn("pos", F.col("place")).withColumn("near", F.col("place") * sign)
        bent = F.col("bend") < 0
        return own.groupBy(F.col(video).alias("__v"), "run").agg(
            F.min("place").alias("first"), F.max("place").alias("last"), F.min(F.when(bent, side)).alias("whole"), F.min(F.when(bent & ~F.col("fresh"), side)).alias("rest")
        )

    turns = s.filter("turn").select(video, frame, "pos", v, (F.col("rise") == 0).cast("long").alias("flat"))
    last = s.groupBy(video).agg(F.max("pos").alias("__last"))
    fall = runs(-1).select("__v", F.col("last").alias("__end"), F.col("first").alias("fall_first"), F.col("whole").alias("left"))
    rise = runs(1).select("__v", F.col("first").alias("__start"), F.col("last").alias("rise_last"), "whole", "rest")
    same = F.col(video).eqNullSafe(F.col("__v"))
    found = turns.join(fall, same & (F.col("pos") == F.col("__end") + 1)).drop("__v", "__end")
    found = found.join(rise, same & (F.col("pos") + F.col("flat") == F.col("__start"))).drop("__v", "__start")
    turn = F.struct(F.lit(0.0).alias("bend"), F.col("pos").alias("near"), F.col("pos").alias("at"), F.col(v).alias("value"), F.col(frame).alias("id"))
    # the turn itself is no side of the run that starts with it
    found = found.withColumn("left", F.coalesce("left", turn)).withColumn("right", F.coalesce(F.when(F.col("flat") == 1, F.col("whole")).otherwise(F.col("rest")), turn))
    inside = (F.col("fall_first") > 0) & (F.col("rise_last") < F.col("__last"))
    wide = with_video(found, last, video).filter(inside & (F.col("right.at") - F.col("left.at") > MIN_DISSOLVE) & (F.col(v) > DISSOLVE_LEVEL) & (F.col("left.value") >= 0) & (F.col("right.value") >= 0))
    middle = s.select(F.col(video).alias("__v"), F.col("pos").alias("__at"), F.col(v).alias("__middle"))
    near = wide.join(middle, same & (F.floor((F.col("left.at") + F.col("right.at")) / 2) == F.col("__at")))
    shape = F.abs(F.col("__middle") - (F.col("left.value") + F.col("right.value")) / 4) < DISSOLVE_SHAPE * F.sqrt("left.value") * F.sqrt("right.value") / 2
    return near.filter(shape).select(video, F.col("left.id").alias("start_frame"), F.col("right.id").alias("end_frame"))


def merged(spans: list[tuple[int, int]], gap: int = GAP, cap: int = CAP) -> list[tuple[int, int]]:
    """Neighbouring intervals joined while they are at most ``gap`` apart and their lengths add up to less than ``cap``."""
    out: list[tuple[int, int]] = []
    length = 0
    for s, e in spans:
        if out and out[-1][1] + gap >= s and length + e - s < cap:
            length += e - s
            out[-1] = out[-1][0], e
        else:
            out.append((s, e))
            length = e - s
    return out


def merge_intervals(spans: DataFrame, gap: int = GAP, cap: int = CAP, video: str = VIDEO, start: str = "start_frame", end: str = "end_frame") -> DataFrame:
    """``video, start, end`` with neighbours merged in order of their starts."""
    narrow = spans.select(video, F.col(start).cast("long").alias(start), F.col(end).cast("long").alias(end))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = merged(sorted(zip(pdf[start].tolist(), pdf[end].tolist(), strict=True)), gap, cap)
        return pd.DataFrame({video: pd.Series([key[0]] * len(out), dtype=object), start: [s for s, _ in out], end: [e for _, e in out]})

    return narrow.groupBy(video).applyInPandas(run, f"`{video}` {narrow.schema[video].dataType.simpleString()}, `{start}` long, `{end}` long")


def numbered(signals: DataFrame, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``signals`` with ``pos``, stored, so that what is computed along them counts the frames once."""
    return signals if "pos" in signals.columns else written(positions(signals, video, frame), "positions")


def dissolves(signals: DataFrame, variance: str = "gray_var", p: float = SMOOTH, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``video, start_frame, end_frame``: merged dissolves of each video, frame ids at both ends."""
    placed = numbered(signals.select(video, frame, *(["pos"] if "pos" in signals.columns else []), F.coalesce(F.col(variance), F.lit(0.0)).alias(variance)), video, frame)
    ratio = by_maximum(placed, variance, "__x", video).select(video, frame, "pos", "__x")
    level = chunked(ratio, lambda w: {"__m": median5(w, "__x")}, 0, 4, video, frame)
    smoothed = smooth(level, "__m", "__s", p, video, frame)
    return merge_intervals(dissolve_spans(smoothed, "__s", video, frame), video=video)


def mask_intervals(frames: DataFrame, intervals: DataFrame, out: str, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``frames`` with ``out`` 0 for frames in an interval, else 1: an equi-join on the intervals' frame numbers."""
    inside = intervals.select(F.col(video).alias("__v"), F.explode(F.sequence("start_frame", "end_frame")).alias("__f")).distinct()
    return frames.join(inside, F.col(video).eqNullSafe(F.col("__v")) & (F.col(frame) == F.col("__f")), "left").withColumn(out, F.when(F.col("__f").isNull(), 1).otherwise(0)).drop("__v", "__f")


def effects(signals: DataFrame, variance: str = "gray_var", dissim: str = "dissim", cut_limit: float = CUT, dissolve: bool = True, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``signals`` with ``effect``: 0 in a fade, at a cut or in a dissolve, else 1."""
    placed = numbered(signals, video, frame)
    first = F.col("pos") == 0
    base = chunked(placed, lambda w: {"__f20": neighbourhood_max(w, dissim, CUT_REACH)}, CUT_REACH, CUT_REACH - 1, video, frame)
    base = base.withColumn("__var", F.when(first, 0.0).otherwise(F.coalesce(F.col(variance), F.lit(0.0))))
    base = by_maximum(base, "__var", "__ratio", video)
    base = mask_intervals(base, dissolves(base, "__var", video=video, frame=frame), "__dissolve", video, frame) if dissolve else base.withColumn("__dissolve", F.lit(1))
    out = base.withColumn("effect", fade(F.col("__ratio")) * cut(F.col("__f20"), cut_limit) * F.col("__dissolve")).drop("__var", "__f20", "__ratio", "__dissolve")
    return out if "pos" in signals.columns else out.drop("pos")


def shots(effect: DataFrame, min_length: int = MIN_SHOT, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``video, shot_id, start_frame, end_frame``: runs of frames without effects, of over ``min_length`` frames.

    A shot starts at the last transition frame before its run, so its length is the run's. Gaps and islands over
    frame places, which no task needs a whole video for."""
    placed = positions(effect.select(video, frame, "effect"), video, frame).withColumnRenamed("pos", "at")
    ones = positions(placed.filter("effect = 1"), video, frame)
    runs = ones.groupBy(video, (F.col("at") - F.col("pos")).alias("run")).agg((F.min(frame) - 1).alias("start_frame"), F.max(frame).alias("end_frame"))
    kept = runs.filter(F.col("end_frame") - F.col("start_frame") > min_length)
    return kept.select(video, F.row_number().over(Window.partitionBy(video).orderBy("start_frame")).alias("shot_id"), "start_frame", "end_frame")


def shot_frames(frames: DataFrame, shot: DataFrame, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``frames`` with the ``shot_id`` that each lies in (ends included; a frame of two shots twice)."""
    inside = shot.select(F.col(video).alias("__v"), "shot_id", F.explode(F.sequence(F.col("start_frame").cast("long"), F.col("end_frame").cast("long"))).alias("__f"))
    return frames.join(inside, F.col(video).eqNullSafe(F.col("__v")) & (F.col(frame) == F.col("__f"))).drop("__v", "__f")


def scene_count(signals: DataFrame, dissim: str = "dissim", reach: int = SCENE_REACH, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``video, nscenes``: frames whose filtered dissimilarity is positive."""
    filtered = chunked(signals, lambda w: {"__f": neighbourhood_max(w, dissim, reach)}, reach, reach - 1, video, frame)
    return filtered.groupBy(video).agg(F.count_if(F.col("__f") > 0).alias("nscenes"))
