"""Frames as a stream: features and consecutive distances, video by video, as files arrive."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FEATURES = "video_id string, frame_id long, hist array<double>"


def read_features(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(FEATURES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def jumps(features: DataFrame, limit: float = 0.4) -> DataFrame:
    """``video_id, frame_id, dist, k``: each frame's distance to the one before it and the jumps so far.

    State: a video's last frame and its count. Frames of a video must arrive in order of their ids."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, k = state.get if state.exists else (None, 0)
        for pdf in batches:
            pdf = pdf.sort_values("frame_id", ignore_index=True)
            rows = []
            for frame, hist in zip(pdf["frame_id"], pdf["hist"], strict=True):
                dist = None if last is None else float(np.sqrt(((np.asarray(hist) - np.asarray(last)) ** 2).sum()))
                k += dist is not None and dist > limit
                last = [float(x) for x in hist]
                rows.append((key[0], int(frame), dist, int(k)))
            yield pd.DataFrame(rows, columns=["video_id", "frame_id", "dist", "k"])
        state.update((last, int(k)))

    return features.groupBy("video_id").applyInPandasWithState(step, "video_id string, frame_id long, dist double, k long", "last array<double>, k long", "append", GroupStateTimeout.NoTimeout)
