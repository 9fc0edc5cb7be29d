"""Sinks: summaries, descriptors, run metrics."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from framelode.functions import names
from framelode.operators.summary import summary_frames, unfinished
from framelode.scratch import delete

METRICS = "arch string, video_id string, length int, resolution string, stage string, seconds double"


def write_summary(frames: DataFrame, keyframes: DataFrame, path: str) -> None:
    """Selected frames as Parquet, a folder a video; only the folders of these videos are replaced."""
    summary_frames(frames, keyframes).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video_id").parquet(path)


def to_summarize(videos: DataFrame, path: str) -> DataFrame:
    """Videos that have no folder in ``path`` yet."""
    try:
        done = videos.sparkSession.read.parquet(path)
    except AnalysisException:
        return videos
    return unfinished(videos, done.select(F.col("video_id").cast("string")))


def append_text(df: DataFrame, column: str, path: str) -> None:
    df.select(column).write.mode("append").text(path)


def write_descriptors(described: DataFrame, path: str, text: bool = False) -> None:
    """Descriptors as Parquet, or as text (six decimals, a space after each), a folder a frame."""
    if text:
        described.select("video_id", "frame_id", names.feature_text(F.col("vec")).alias("value")).write.mode("overwrite").partitionBy("video_id", "frame_id").text(path)
    else:
        described.write.mode("overwrite").partitionBy("video_id").parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of any store that Spark reaches."""
    return delete(spark, path)


def copy(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a file or folder between any stores that Spark reaches; folders of ``target`` are made, a file there is replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    return jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def make_folder(spark: SparkSession, path: str) -> bool:
    """Make a folder with those above it; one that exists stays as it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


class RunMetrics:
    """Wall times of stages, as a table. A stage's time is that of the actions in its block."""

    def __init__(self, arch: str = "spark"):
        self.arch, self.rows = arch, []

    @contextmanager
    def stage(self, name: str, video_id: str = "", length: int | None = None, resolution: str | None = None) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.rows.append((self.arch, video_id, length, resolution, name, time.perf_counter() - began))

    def timed(self, name: str, f: Callable, *args, **kwargs):
        with self.stage(name):
            return f(*args, **kwargs)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, METRICS)

    def write(self, spark: SparkSession, path: str, separator: str = ";") -> None:
        """Appended lines without a header; seconds with four decimals, -1 where not measured."""
        self.table(spark).withColumn("seconds", names.seconds_text(F.col("seconds"))).coalesce(1).write.mode("append").csv(path, sep=separator, header=False)
