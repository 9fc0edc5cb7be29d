"""The two summarization methods, from features to summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelode.functions import vec
from framelode.operators import bovw, cluster, histogram, signal
from framelode.operators.sequence import chunked
from framelode.scratch import written
from framelode.sources import frames as source


@dataclass(frozen=True)
class Preset:
    """What the published variants of the histogram method do differently.

    ``spread``: the form of the filter of meaningless frames, at most ``max_std`` (``histogram.spread_of``), over ``bins``: 16 (of V),
    48 (of H, S and V) or 256 (of V). ``fps``: the rate that frames are sampled by; none: the video's own. ``empty``: what becomes of
    clusters without frames, and ``single``: whether a cluster of one frame moves (``cluster.kmeans``)."""

    metric: str = "l2"
    k_thresholds: tuple[float, ...] = (0.4,)
    dedup: float = 0.3
    max_std: float = 0.23
    spread: str = "std"
    bins: int = 48
    fps: float | None = None
    empty: str = "keep"
    single: bool = True

    @property
    def filter_column(self) -> str:
        return "hist_norm" if self.bins == 16 else f"hist{self.bins}_norm"

    def sampled(self, frames: DataFrame, frame_no: Column, fps: Column | float) -> DataFrame:
        """Every frame at a whole second of the preset's rate or, where it has none, of the video's."""
        return source.sampled(frames, frame_no, fps if self.fps is None else self.fps)


# Parameters of the published variants.
PRESETS = {
    "python": Preset(),
    "python_dropped": Preset(empty="drop"),
    "cpu": Preset(k_thresholds=(0.4, -0.6), bins=16),
    "multicore": Preset(metric="l1", k_thresholds=(2.0, 1.0, 0.0), dedup=0.5, single=False),
    "gpu": Preset(metric="l1", k_thresholds=(1.0, 0.0), dedup=0.5, spread="fixed_mean", bins=256, fps=25.0),
    "gpu_fused": Preset(metric="l1", k_thresholds=(1.0, 0.0), dedup=0.5, max_std=0.5, spread="root_squares", bins=16, fps=25.0),
}


def image_frames(images: DataFrame, preset: Preset | str = "python") -> DataFrame:
    """``video_id, frame_id, hist, hist_norm`` (16 bins of V), and the histogram that the preset filters by, from images."""
    p = PRESETS[preset] if isinstance(preset, str) else preset
    f = histogram.image_features(images, "hsv", 256 if p.bins == 256 else 16)
    v = histogram.value_channel(F.col("hist"), 256 if p.bins == 256 else 16)
    f = f.withColumn("hist48_norm", vec.normalise("hist", "n_pixels")).withColumn("hist256_norm", vec.normalise(v, "n_pixels"))
    f = f.withColumn("hist", histogram.fold(v) if p.bins == 256 else v)
    return histogram.with_norm(f).select("video_id", "frame_id", "n_pixels", "hist", "hist_norm", *([p.filter_column] if p.bins != 16 else []))


def histogram_summary(features: DataFrame, preset: Preset | str = "python") -> DataFrame:
    """``video_id, frame_id``: meaningful frames, as many clusters as there are jumps, the frame nearest to each centroid,
    and no near copies. ``features``: ``video_id, frame_id, hist, hist_norm``, and the preset's filter column, for which
    features of one channel have ``hist_norm`` alone. A video without frames has no summary."""
    p = PRESETS[preset] if isinstance(preset, str) else preset
    by = p.filter_column if p.filter_column in features.columns else "hist_norm"
    kept = written(histogram.meaningful(features, p.max_std, p.spread, by).select("video_id", "frame_id", "hist", "hist_norm"), "features")
    k = cluster.estimate_k(kept, "hist_norm", p.k_thresholds, p.metric)
    assigned, _ = cluster.kmeans(kept, k, "hist", p.metric, stable=True, empty=p.empty, single=p.single)
    keys = cluster.keyframes(assigned).select("video_id", "frame_id")
    return cluster.dedup_greedy(kept.join(keys, ["video_id", "frame_id"], "left_semi"), "hist_norm", p.dedup, p.metric)


@dataclass(frozen=True)
class ShotParameters:
    cut_limit: float = signal.CUT
    min_shot: int = signal.MIN_SHOT
    words: int = 150
    shot_clusters: int = 10
    shot_passes: int = 300
    shot_splits: int = 3
    scene_passes: int = 1000
    scene_splits: int = 4
    scene_factor: int = 4
    cutoff: float = 0.0


def segmentation_signals(features: DataFrame) -> DataFrame:
    """``video_id, frame_id, gray_var, hist, dissim`` and the frames' places, stored: what cuts, scenes and dissolves are found in."""
    return written(chunked(signal.numbered(features), lambda w: {"dissim": signal.dissimilarity(w, "hist")}, 1, 1), "signals")


def segmentation(features: DataFrame, params: ShotParameters | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(shots, scene counts, effects)`` from ``video_id, frame_id, hist, gray_var``."""
    params = params or ShotParameters()
    signals = segmentation_signals(features)
    masked = signal.effects(signals, cut_limit=params.cut_limit)
    return signal.shots(masked, params.min_shot), signal.scene_count(signals), masked


def shot_summary(features: DataFrame, descriptors: DataFrame, params: ShotParameters | None = None) -> DataFrame:
    """``video_id, frame_id``: shots, representative frames of each, a bag of visual words for each of these, and the
    frame nearest to each cluster of bags. ``descriptors``: ``video_id, frame_id, desc_id, vec``."""
    params = params or ShotParameters()
    features = written(features.select("video_id", "frame_id", "hist", "gray_var"), "features")
    shots, scenes, _ = segmentation(features, params)
    scenes = written(scenes, "scenes")
    in_shots = signal.shot_frames(features.select("video_id", "frame_id", "hist"), shots)
    reps = cluster.xmeans_groups(in_shots, ("video_id", "shot_id"), "hist", 1, params.shot_clusters, params.shot_passes, params.shot_splits, params.cutoff).select("video_id", "frame_id").distinct()
    own = written(descriptors.join(written(reps, "representatives"), ["video_id", "frame_id"], "left_semi"), "descriptors")
    words, _ = cluster.lbg(own, "vec", params.words)
    spark = features.sparkSession
    book = spark.createDataFrame([(k, w.tolist()) for k, w in enumerate(words)], "cluster_id int, vec array<double>")
    bags = bovw.dense_words(bovw.word_histogram(own, book), len(words))
    return scene_keyframes(bags, scenes, params)


def scene_keyframes(bags: DataFrame, scenes: DataFrame, params: ShotParameters) -> DataFrame:
    """X-means over a video's bags, from its scene count to four times that, and the frame nearest to each centroid."""
    import numpy as np
    import pandas as pd

    passes, factor, splits, cutoff = params.scene_passes, params.scene_factor, params.scene_splits, params.cutoff
    joined = bags.join(scenes, "video_id").withColumn("nscenes", F.greatest("nscenes", F.lit(1)))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_id", ignore_index=True)
        x, k = np.array(pdf["hist"].tolist(), float), int(pdf["nscenes"].iloc[0])
        label, c = cluster.xmeans(x, k, factor * k, passes, splits, cutoff)
        near = sorted({int(np.sqrt(((x - c[j]) ** 2).sum(1)).argmin()) for j in range(len(c)) if (label == j).any()})
        return pdf.iloc[near][["video_id", "frame_id"]]

    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in ("video_id", "frame_id"))
    return joined.groupBy("video_id").applyInPandas(run, kinds)
