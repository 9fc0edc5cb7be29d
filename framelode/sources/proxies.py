"""Frame sequences out of ordinary tables, to run the operators on text, vectors and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.operators import histogram


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a video, a document a frame, a character a pixel: ``video_id, frame_id, n_pixels, hist, hist_norm``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("video_id"), F.col("doc_id").alias("frame_id"), "text")
    return histogram.with_norm(histogram.from_text(docs, "text"))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label is a video, a vector a frame: ``video_id, frame_id, hist``."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame_id"), F.col("embedding").cast("array<double>").alias("hist"))


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An hour is a frame, an event a pixel: ``video_id, frame_id (hours since the epoch), event_type, gray``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    return e.select(F.lit("events").alias("video_id"), hour.alias("frame_id"), "event_type", F.least(F.lit(255), F.floor("value")).cast("int").alias("gray"))


def event_signals(spark: SparkSession, sf_dir: str, types: tuple[str, ...] | None = None) -> DataFrame:
    """``video_id, frame_id, gray_var, hist``: gray variance, and 16 bins for each of five event types."""
    pixels = event_pixels(spark, sf_dir)
    order = types or tuple(sorted(r[0] for r in pixels.select("event_type").distinct().collect()))
    channel = F.array_position(F.array(*map(F.lit, order)), F.col("event_type")).cast("int") - 1
    place = F.floor(F.col("gray") / 16) + channel * 16
    counts = [F.count(F.when(place == k, 1)).cast("double") for k in range(16 * len(order))]
    return pixels.groupBy("video_id", "frame_id").agg(F.var_pop("gray").alias("gray_var"), F.array(*counts).alias("hist"))
