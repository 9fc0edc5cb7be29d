"""Windows over frame sequences that survive a hot video.

A plain window takes all frames of a video to one task. ``chunked`` numbers the frames of each video
(by counts of id ranges, so no task needs a whole video), cuts the sequence into chunks, and gives each
chunk the rows before and after it that a bounded frame can reach. Windows then run by video and chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

VIDEO, FRAME = "video_id", "frame_id"
SPAN = 1 << 16


def by_frame(video: str = VIDEO, frame: str = FRAME) -> WindowSpec:
    return Window.partitionBy(video).orderBy(frame)


def positions(df: DataFrame, video: str = VIDEO, frame: str = FRAME, span: int = SPAN) -> DataFrame:
    """``df`` with ``pos``, the place of each frame in its video from 0. Frames are dealt by ranges of ``span`` ids."""
    ranged = df.withColumn("__range", F.floor(F.col(frame) / span).cast("long"))
    sizes = ranged.groupBy(video, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(video).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(video).alias("__v"), F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy(video, "__range").orderBy(frame)) - 1
    placed = ranged.withColumn("__at", within).join(starts, F.col(video).eqNullSafe(F.col("__v")) & (F.col("__range") == F.col("__r")))
    return placed.withColumn("pos", F.col("__start") + F.col("__at")).drop("__v", "__r", "__range", "__start", "__at")


def chunks(df: DataFrame, before: int, after: int, video: str = VIDEO, frame: str = FRAME, rows: int = SPAN, span: int = SPAN) -> DataFrame:
    """``df`` with ``pos``, dealt to ``__chunk``: a chunk's own ``rows`` (``__own``), and those up to ``before`` rows back and ``after``
    rows ahead of one. A ``pos`` that ``df`` has is taken as it is."""
    placed = (df if "pos" in df.columns else positions(df, video, frame, span)).withColumn("__own", F.floor(F.col("pos") / rows).cast("long"))
    first, last = F.floor((F.col("pos") - after) / rows).cast("long"), F.floor((F.col("pos") + before) / rows).cast("long")
    return placed.withColumn("__chunk", F.explode(F.sequence(F.greatest(first, F.lit(0).cast("long")), last)))


def chunked(df: DataFrame, compute: Callable[[WindowSpec], dict[str, Column]], before: int, after: int, video: str = VIDEO, frame: str = FRAME, rows: int = SPAN, span: int = SPAN) -> DataFrame:
    """``df`` with the window columns that ``compute`` makes of a window ordered by frame.

    They may look at ``before`` rows back and ``after`` rows ahead at most; ``rows`` is a chunk's length."""
    dealt = chunks(df, before, after, video, frame, rows, span)
    w = Window.partitionBy(video, "__chunk").orderBy("pos")
    out = dealt.select("*", *(c.alias(n) for n, c in compute(w).items())).filter("__own = __chunk").drop("__own", "__chunk")
    return out if "pos" in df.columns else out.drop("pos")


def with_video(df: DataFrame, per_video: DataFrame, video: str = VIDEO, few: int = 1 << 17) -> DataFrame:
    """``df`` with the columns of a table of one row a video: broadcast up to ``few`` videos, so that a large video meets no single task."""
    named = per_video.withColumnRenamed(video, "__v")
    named = F.broadcast(named) if named.count() <= few else named
    return df.join(named, F.col(video).eqNullSafe(F.col("__v"))).drop("__v")
