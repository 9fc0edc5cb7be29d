"""Sources: videos, frame images, sampled frames, descriptor and centre files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.functions import names

FRAME_SCHEMA = "video_id string, frame_id int, height int, width int, data binary"


def list_videos(spark: SparkSession, path: str, suffix: str = ".avi") -> DataFrame:
    """``video_id, path, length, resolution, bytes`` of the files of one folder, by name. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).select("path", F.col("length").alias("bytes"))
    name = names.simple_name(F.col("path"))
    found = files.select(name.alias("video_id"), "path", names.video_attributes(name).alias("a"), "bytes")
    return found.select("video_id", "path", F.col("a.length").alias("length"), F.col("a.resolution").alias("resolution"), "bytes").orderBy("path")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Frames from image files ``<video>/frame-000001.jpg``: bytes in BGR order, numbered by the file's name."""
    image = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")
    parts = F.split("origin", "/")
    return image.select(F.element_at(parts, -2).alias("video_id"), F.regexp_extract("origin", r"([0-9]+)\.[^.]*$", 1).cast("int").alias("frame_id"), "height", "width", "data")


def sampled(frames: DataFrame, frame_no: Column, fps: Column | float) -> DataFrame:
    """Frames at positions 0, n, 2n ... with n the whole part of fps, numbered from 1 in ``frame_id``; ``frame_no`` counts from 0.

    A narrow projection: the number follows from the position, and no window is needed."""
    step = F.greatest(F.floor(fps if isinstance(fps, Column) else F.lit(fps)), F.lit(1)).cast("long")
    return frames.filter(frame_no % step == 0).withColumn("frame_id", F.floor(frame_no / step).cast("int") + 1)


def decode(videos: DataFrame, decoder: Callable[..., Iterator[tuple[int, int, int, bytes]]], every: int = 1, ranges: int = 1, seeks: bool = False, batch: int = 1 << 23) -> DataFrame:
    """Frames of ``videos (video_id, path)`` by a decoder: path to ``(position, height, width, BGR bytes)``.

    A video is dealt to ``ranges`` tasks; every ``every``-th frame is kept, numbered from 1. A decoder that ``seeks`` is called with
    ``(path, part, ranges)`` and gives the frames of its own range of positions, so that a video is decoded once in all. One that
    can't reads the whole video in each task, which keeps the positions of its residue. Frames are sent ``batch`` bytes at once."""
    dealt = videos.select("video_id", "path", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("part")).repartition("video_id", "part")
    schema = pa.schema([("video_id", pa.string()), ("frame_id", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for video, path, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for no, h, w, data in decoder(path, part, ranges) if seeks else decoder(path):
                    if no % every == 0 and (seeks or no // every % ranges == part):
                        held.append((video, no // every + 1, h, w, data))
                        size += len(data)
                        if size >= batch:
                            yield sent()
                            held, size = [], 0
        if held:
            yield sent()

    return dealt.mapInArrow(scan, FRAME_SCHEMA)


def discard(frames: DataFrame) -> None:
    """Read every frame and keep none: a timing probe."""
    frames.write.format("noop").mode("overwrite").save()


def read_matrix(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``frame, vec`` from descriptor text: a row a line, numbers with spaces between (a last space adds nothing).

    A folder or several paths are read together; ``frame`` is the file's name without its extension."""
    lines = spark.read.text(path).select(names.simple_name(F.input_file_name()).alias("frame"), F.trim("value").alias("value"))
    return lines.filter("value <> ''").select("frame", F.transform(F.split("value", r"\s+"), lambda x: x.cast("double")).alias("vec"))


def read_centres(spark: SparkSession, path: str) -> DataFrame:
    """``vec`` from comma-separated rows."""
    return spark.read.text(path).filter("trim(value) <> ''").select(F.transform(F.split(F.rtrim("value"), ","), lambda x: F.trim(x).cast("double")).alias("vec"))
