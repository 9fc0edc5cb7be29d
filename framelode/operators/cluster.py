"""Clustering of frames: k estimation, k-means, codebooks, X-means, keyframes, greedy deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from framelode.functions import vec
from framelode.operators.sequence import FRAME, SPAN, VIDEO, chunked
from framelode.scratch import written

MAX_PASSES = 501
GROUP_ROWS = 100_000  # frames of a video that one task may hold; larger videos are distributed
DRIVER_ROWS = 20_000  # centroids that may pass through the driver; more are written tables
K_LIMIT, DEDUP_LIMIT = 0.4, 0.3
LBG_STEP = 0.051


def estimate_k(frames: DataFrame, hist: str = "hist_norm", thresholds: tuple[float, ...] = (K_LIMIT,), metric: str = "l2", video: str = VIDEO, frame: str = FRAME, rows: int = SPAN) -> DataFrame:
    """``video, k``: how often consecutive frames differ by more than a threshold, 1 at least.

    Thresholds are tried in order until one is passed. One lag, in chunks, and one aggregate."""

    def lagged(w: WindowSpec) -> dict[str, Column]:
        return {"__d": vec.DISTANCES[metric](F.col(hist), F.lag(hist).over(w))}

    d = chunked(frames.select(video, frame, hist), lagged, 1, 0, video, frame, rows)
    counts = [F.count_if(F.col("__d") > t) for t in thresholds]
    return d.groupBy(video).agg(F.coalesce(*(F.when(c > 0, c) for c in counts), F.lit(1)).cast("long").alias("k"))


def first_rows(frames: DataFrame, k: int | DataFrame, vector: str, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``video, cluster_id, vec``: the first k frames of each video as seeds. Row limits reach the map side."""
    w = Window.partitionBy(video).orderBy(frame)
    numbered = frames.select(video, F.col(vector).alias("vec"), F.row_number().over(w).alias("rn"))
    if isinstance(k, int):
        return numbered.filter(F.col("rn") <= k).select(video, (F.col("rn") - 1).alias("cluster_id"), "vec")
    most = k.agg(F.max("k")).first()[0] or 0
    limits = k.select(F.col(video).alias("__v"), "k")
    kept = numbered.filter(F.col("rn") <= most).join(limits, F.col(video).eqNullSafe(F.col("__v"))).filter(F.col("rn") <= F.col("k"))
    return kept.select(video, (F.col("rn") - 1).alias("cluster_id"), "vec")


def assign(frames: DataFrame, centroids: DataFrame, vector: str, metric: str = "l2", video: str = VIDEO) -> DataFrame:
    """``frames`` with ``cluster_id`` and ``dist`` of the nearest centroid of the same video; ties go to the least id."""
    lists = centroids.groupBy(F.col(video).alias("__v")).agg(F.collect_list(F.struct("cluster_id", "vec")).alias("__c"))
    return assign_lists(frames, lists, vector, metric, video)


def assign_lists(frames: DataFrame, lists: DataFrame, vector: str, metric: str, video: str) -> DataFrame:
    joined = frames.join(lists, F.col(video).eqNullSafe(F.col("__v"))).withColumn("__n", vec.nearest(vector, "__c", metric))
    return joined.withColumns({"cluster_id": F.col("__n.cluster_id"), "dist": F.col("__n.dist")}).drop("__v", "__c", "__n")


def nearest_centroid(points: DataFrame, centroids: DataFrame, vector: str, metric: str = "l2") -> DataFrame:
    """``points`` with ``cluster_id`` and ``dist`` of the nearest of all centroids (``cluster_id, vec``).

    Centroids are few (a codebook): they are collected, with a check, and compared in numpy, batch by batch."""
    c, ids = codebook_arrays(centroids)
    names, at = points.columns, points.columns.index(vector)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, dist = nearest_rows(vectors(b.column(at)), c, metric)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids[label], pa.int64()), pa.array(dist)], [*names, "cluster_id", "dist"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(scan, f"{schema}, cluster_id long, dist double")


def codebook_arrays(centroids: DataFrame, limit: int = 65536) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r["cluster_id"], r["vec"]) for r in centroids.select("cluster_id", "vec").limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError(f"over {limit} centroids: use assign() by video")
    return np.array([v for _, v in rows], float), np.array([i for i, _ in rows], np.int64)


def vectors(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def distance_table(x: np.ndarray, c: np.ndarray, metric: str = "l2") -> np.ndarray:
    """Distances of each row of x from each row of c, summed entry by entry as ``vec.DISTANCES`` and SQL do: numpy's own sums take
    another order, and differ in the last bit, on which ties and limits can turn."""
    out = np.zeros((len(x), len(c)))
    for a, b in zip(np.ascontiguousarray(x.T), c.T, strict=True):
        d = a[:, None] - b[None, :]
        out += np.abs(d) if metric == "l1" else d * d
    return out if metric == "l1" else np.sqrt(out)


def nearest_rows(x: np.ndarray, c: np.ndarray, metric: str = "l2", cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of c for each row of x (first one on ties) and its distance; ``cells`` differences at once, or one row's."""
    label, dist = np.zeros(len(x), np.int64), np.zeros(len(x))
    chunk = max(1, min(1024, cells // max(1, c.size)))
    for s in range(0, len(x), chunk):
        d = distance_table(x[s : s + chunk], c, metric)
        label[s : s + chunk] = d.argmin(1)
        dist[s : s + chunk] = d.min(1)
    return label, dist


def means(assigned: DataFrame, vector: str, size: int, video: str = VIDEO) -> DataFrame:
    """``video, cluster_id, vec, n`` and a checksum of the labels, from assigned frames: partial sums, no exploding."""
    return assigned.groupBy(video, "cluster_id").agg(vec.mean_vector(vector, size).alias("vec"), F.count("*").alias("n"), F.bit_xor(F.xxhash64(video, FRAME, "cluster_id")).alias("mark"))


def kmeans(frames: DataFrame, k: int | DataFrame, vector: str = "hist", metric: str = "l2", max_passes: int = MAX_PASSES, video: str = VIDEO, stable: bool = False, empty: str = "keep", single: bool = True) -> tuple[DataFrame, DataFrame]:
    """k-means of each video's frames: ``(frames with cluster_id and dist, centroids video, cluster_id, vec)``.

    Seeds are the first k frames; a cluster without frames keeps its centroid (``empty="drop"``: is dropped, ids stay);
    a cluster of one frame moves to it (``single=False``: keeps its centroid); passes end when no label changes.
    Videos of at most ``GROUP_ROWS`` frames run each in one task, larger ones in one job a pass, in which no task holds a
    video. Frames are stored first, unless they are ``stable``: a stored table already."""
    points = frames.filter(F.col(vector).isNotNull())
    points = points if stable else written(points, "points")
    sizes = points.groupBy(F.col(video).alias("__v")).agg(F.count("*").alias("__rows"))
    large = written(sizes.filter(F.col("__rows") > GROUP_ROWS), "large-videos")
    if large.isEmpty():
        return grouped_kmeans(points, k, vector, metric, max_passes, video, empty, single)
    same = F.col(video).eqNullSafe(F.col("__v"))
    small = grouped_kmeans(points.join(large, same, "left_anti"), k, vector, metric, max_passes, video, empty, single)
    rest = distributed_kmeans(points.join(large, same, "left_semi"), k, vector, metric, max_passes, video, empty, single)
    return small[0].unionByName(rest[0]), small[1].unionByName(rest[1])


def grouped_kmeans(points: DataFrame, k: int | DataFrame, vector: str, metric: str, max_passes: int, video: str, empty: str = "keep", single: bool = True) -> tuple[DataFrame, DataFrame]:
    """k-means of videos of at most ``GROUP_ROWS`` frames: all passes of a video in one task, once; labels and centroids are stored."""
    names = points.columns
    if isinstance(k, int):
        counted = points.withColumn("__k", F.lit(k))
    else:
        counted = points.join(k.select(F.col(video).alias("__v"), F.col("k").cast("int").alias("__k")), F.col(video).eqNullSafe(F.col("__v"))).drop("__v")

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(FRAME, ignore_index=True)
        x = np.array(pdf[vector].tolist(), float)
        c, seen = x[: int(pdf["__k"].iloc[0])].copy(), None
        ids = np.arange(len(c))
        for _ in range(max_passes):
            label, _ = nearest_rows(x, c, metric)
            sums, n = np.zeros_like(c), np.bincount(label, minlength=len(c))
            np.add.at(sums, label, x)
            c = np.where((n > (0 if single else 1))[:, None], sums / np.maximum(n, 1)[:, None], c)
            if empty == "drop" and (n == 0).any():
                c, ids, seen = c[n > 0], ids[n > 0], None
                continue
            if seen is not None and np.array_equal(label, seen):
                break
            seen = label
        label, dist = nearest_rows(x, c, metric)
        frames = pdf[names].assign(cluster_id=ids[label].astype(np.int32), dist=dist, __c=None)
        centroids = pd.DataFrame({q: [pdf[q].iloc[0] if q == video else None] * len(c) for q in names}).assign(cluster_id=ids.astype(np.int32), dist=np.nan, __c=list(c))
        return pd.concat([frames.astype(object), centroids.astype(object)], ignore_index=True)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    both = written(counted.groupBy(video).applyInPandas(fitted, f"{schema}, cluster_id int, dist double, __c array<double>"), "kmeans")
    return both.filter("__c IS NULL").drop("__c"), both.filter("__c IS NOT NULL").select(video, "cluster_id", F.col("__c").alias("vec"))


def distributed_kmeans(points: DataFrame, k: int | DataFrame, vector: str, metric: str, max_passes: int, video: str, empty: str = "keep", single: bool = True) -> tuple[DataFrame, DataFrame]:
    """k-means of videos of any size, all of them in one job a pass."""
    points = written(points, "points")
    size = points.agg(F.max(F.size(vector))).first()[0] or 1
    centroids = written(first_rows(points, k, vector, video), "centroids")
    if centroids.count() <= DRIVER_ROWS:
        return few_centroids(points, centroids, vector, size, metric, max_passes, video, empty, single)
    seen = None
    for _ in range(max_passes):
        new = written(means(assign(points, centroids, vector, metric, video), vector, size, video), "means")
        mark = new.agg(F.bit_xor("mark"), F.sum("n")).first()
        old = centroids.select(F.col(video).alias("__v"), F.col("cluster_id").alias("__c"), F.col("vec").alias("__old"))
        joined = old.join(new, F.col("__v").eqNullSafe(F.col(video)) & (F.col("__c") == F.col("cluster_id")), "inner" if empty == "drop" else "left")
        moved = F.when(F.col("n") > (0 if single else 1), F.col("vec")).otherwise(F.col("__old"))
        centroids = written(joined.select(F.col("__v").alias(video), F.col("__c").alias("cluster_id"), moved.alias("vec")), "centroids")
        if mark == seen:
            break
        seen = mark
    return assign(points, centroids, vector, metric, video), centroids


def few_centroids(points: DataFrame, centroids: DataFrame, vector: str, size: int, metric: str, max_passes: int, video: str, empty: str = "keep", single: bool = True) -> tuple[DataFrame, DataFrame]:
    """The passes of k-means with the centroids on the driver: one job each, in which each batch gives partial sums."""
    kind, names = points.schema[video].dataType.simpleString(), points.columns
    now = {(r[video], r["cluster_id"]): r["vec"] for r in centroids.collect()}
    at_video, at_vector, at_frame = names.index(video), names.index(vector), names.index(FRAME)

    def by_video() -> dict:
        out: dict = {}
        for (v, c), x in sorted(now.items(), key=lambda e: e[0][1]):
            out.setdefault(v, ([], []))[0].append(c)
            out[v][1].append(x)
        return {v: (np.array(ids), np.array(x, float)) for v, (ids, x) in out.items()}

    def labelled(b: pa.RecordBatch, lists: dict) -> Iterator[tuple[object, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By video: rows, vectors, labels and distances of a batch."""
        x, keys = vectors(b.column(at_vector)), b.column(at_video).to_pylist()
        rows: dict = {}
        for i, v in enumerate(keys):
            rows.setdefault(v, []).append(i)
        for v, own in rows.items():
            ids, c = lists[v]
            label, dist = nearest_rows(x[own], c, metric)
            yield v, np.array(own), x[own], ids[label], dist

    def summing(lists: dict):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                frames = pd.util.hash_array(np.array(b.column(at_frame).to_pylist()))
                out: list[list] = [[], [], [], [], []]
                for v, own, x, label, _ in labelled(b, lists):
                    z = (frames[own] ^ np.uint64(hash_text(v))) * (label.astype(np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))
                    for c in np.unique(label):
                        of = label == c
                        row = v, int(c), int(of.sum()), x[of].sum(0).tolist(), int(np.bitwise_xor.reduce(z[of] ^ (z[of] >> np.uint64(31))).view(np.int64))
                        for col, value in zip(out, row, strict=True):
                            col.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema.field(at_video).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.float64())), pa.array(out[4], pa.int64())], ["v", "c", "n", "sums", "mark"])

        return scan

    def assigning(lists: dict):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                label, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
                for _, own, _, own_label, own_dist in labelled(b, lists):
                    label[own], dist[own] = own_label, own_dist
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(label, pa.int32()), pa.array(dist)], [*names, "cluster_id", "dist"])

        return scan

    seen = None
    for _ in range(max_passes):
        parts = points.mapInArrow(summing(by_video()), f"v {kind}, c int, n long, sums array<double>, mark long")
        mark, used = 0, set()
        for r in parts.groupBy("v", "c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[j]) for j in range(size))).alias("sums"), F.bit_xor("mark").alias("mark")).collect():
            used.add((r["v"], r["c"]))
            if r["n"] > 1 or single:
                now[r["v"], r["c"]] = [x / r["n"] for x in r["sums"]]
            mark ^= r["mark"]
        if empty == "drop" and len(used) < len(now):
            now, seen = {at: x for at, x in now.items() if at in used}, None
            continue
        if mark == seen:
            break
        seen = mark
    table = points.sparkSession.createDataFrame([(v, c, x) for (v, c), x in now.items()], f"`{video}` {kind}, cluster_id int, vec array<double>")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(assigning(by_video()), f"{schema}, cluster_id int, dist double"), table


def hash_text(v: object) -> int:
    """A number for a video id that is the same in every process."""
    return int.from_bytes(str(v).encode()[-8:], "big")


def keyframes(assigned: DataFrame, video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``video, cluster_id, frame_id, dist``: the member nearest to each centroid; ties go to the first frame."""
    best = assigned.groupBy(video, "cluster_id").agg(F.min(F.struct("dist", frame)).alias("m"))
    return best.select(video, "cluster_id", F.col(f"m.{frame}").alias(frame), F.col("m.dist").alias("dist"))


def distortion(assigned: DataFrame, keys: tuple[str, ...] = (VIDEO,)) -> DataFrame:
    """``keys, distortion``: the sum of squared distances to the assigned centroids."""
    return assigned.groupBy(*keys).agg(F.sum(F.col("dist") * F.col("dist")).alias("distortion"))


def column_means(points: DataFrame, vector: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The mean vector of all points (or of each key's)."""
    size = points.agg(F.max(F.size(vector))).first()[0] or 1
    return points.groupBy(*keys).agg(vec.mean_vector(vector, size).alias("vec"), F.count("*").alias("n"))


def label_changes(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = (VIDEO, FRAME)) -> DataFrame:
    """``changed``: rows whose ``cluster_id`` differs between two assignments of the same frames."""
    both = old.select(*keys, F.col("cluster_id").alias("__old")).join(new.select(*keys, F.col("cluster_id").alias("__new")), list(keys))
    return both.agg(F.count_if(F.col("__old") != F.col("__new")).alias("changed"))


def perturb_constant(x: np.ndarray, step: float = 1e-6) -> np.ndarray:
    """Columns that never change get a tiny slope. Our X-means does not need it; for users of other tools."""
    x = x.copy()
    flat = np.ptp(x, axis=0) == 0 if len(x) else np.zeros(0, bool)
    x[:, flat] += np.arange(len(x))[:, None] * step
    return x


def lloyd(points: DataFrame, vector: str, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass over all points: new means (an empty cell keeps its centroid), counts, and the distortion under the new means.

    Each batch gives one partial sum a cell; the driver holds cells times entries."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = centroids.shape
        n, sums, squares = np.zeros(k, np.int64), np.zeros((k, d)), 0.0
        for b in batches:
            x = vectors(b.column(0))
            if len(x):
                label, _ = nearest_rows(x, centroids)
                n += np.bincount(label, minlength=k)
                np.add.at(sums, label, x)
                squares += float((x * x).sum())
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array(sums.tolist(), pa.list_(pa.float64())), pa.array([squares] + [0.0] * (k - 1))], ["c", "n", "sums", "squares"])

    d = centroids.shape[1]
    parts = points.select(vector).mapInArrow(scan, "c int, n long, sums array<double>, squares double")
    rows = parts.groupBy("c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[j]) for j in range(d))).alias("sums"), F.sum("squares").alias("squares")).collect()
    n, sums = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
    for r in rows:
        n[r["c"]], sums[r["c"]] = r["n"], r["sums"]
    new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return new, n, max(0.0, float(sum(r["squares"] for r in rows) - (n[:, None] * new * new).sum()))


def lbg(points: DataFrame, vector: str = "vec", words: int = 150, step: float = LBG_STEP, passes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Codebook by binary splitting: ``(words x entries, points of each word)``.

    From the mean of all points, cells split into c (1 + step) and c (1 - step) until there are enough; after each
    split Lloyd passes run until the relative gain in distortion is at most ``step`` (or ``passes`` times). The first
    ``words`` are kept; their counts are those of the last pass."""
    points = written(points.filter(F.col(vector).isNotNull()).select(vector), "descriptors")
    first = column_means(points, vector).first()
    if not first["n"]:
        return np.zeros((0, 0)), np.zeros(0, np.int64)
    c = np.array([first["vec"]])
    n = np.array([first["n"]])
    while len(c) < words:
        c = np.concatenate([c * (1 + step), c * (1 - step)])
        old, runs = float("inf"), 0
        while True:
            c, n, now = lloyd(points, vector, c)
            runs += 1
            gain = (old - now) / old if np.isfinite(old) and old > 0 else float("inf") if np.isinf(old) else 0.0
            old = now
            if runs == passes or passes is None and (gain <= step or now <= step):
                break
    return c[:words], n[:words]


def bic(x: np.ndarray, label: np.ndarray, c: np.ndarray) -> float:
    """Bayesian information criterion of spherical clusters of one shared variance."""
    n, d = x.shape
    k = len(c)
    if n <= k:
        return -np.inf
    variance = max(((x - c[label]) ** 2).sum() / (d * (n - k)), 1e-12)
    sizes = np.bincount(label, minlength=k)
    sizes = sizes[sizes > 0]
    likelihood = (sizes * np.log(sizes / n)).sum() - n * d / 2 * np.log(2 * np.pi * variance) - d * (n - k) / 2
    return float(likelihood - k * (d + 1) / 2 * np.log(n))


def local_kmeans(x: np.ndarray, c: np.ndarray, passes: int) -> tuple[np.ndarray, np.ndarray]:
    label = np.full(len(x), -1)
    for _ in range(passes):
        new, _ = nearest_rows(x, c)
        if np.array_equal(new, label):
            break
        label = new
        for k in range(len(c)):
            if (label == k).any():
                c[k] = x[label == k].mean(0)
    return label, c


def xmeans(x: np.ndarray, k: int = 1, most: int = 10, passes: int = 300, splits: int | None = None, cutoff: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """X-means: k-means, then each cluster splits in two along its widest direction where that raises the
    criterion, until none does or there are ``most``. Deterministic. Returns labels and centroids.

    ``splits``: rounds of splitting at most. ``cutoff``: where no split raises the criterion, this share of the clusters
    is split all the same, those that lose least first. The leaf and box sizes of other programs bound a search tree; here
    each pass is exact without one, so there are no such parameters."""
    k = max(1, min(k, len(x)))
    label, c = local_kmeans(x, x[np.linspace(0, len(x) - 1, k).astype(int)].astype(float).copy(), passes)
    rounds = 0
    while len(c) < most and (splits is None or rounds < splits):
        rounds += 1
        halves: dict[int, tuple[float, list]] = {}  # by cluster: what the criterion gains, and the two
        for j in range(len(c)):
            own = x[label == j]
            if len(own) > 3 and np.ptp(own, axis=0).max() > 0:
                centered = own - own.mean(0)
                axis = np.linalg.svd(centered, full_matrices=False)[2][0]
                axis = axis * (1 if axis[np.abs(axis).argmax()] > 0 else -1)
                reach = np.sqrt((centered @ axis).var()) * axis
                two, children = local_kmeans(own, np.array([own.mean(0) - reach, own.mean(0) + reach]), passes)
                halves[j] = bic(own, two, children) - bic(own, np.zeros(len(own), int), own.mean(0)[None, :]), list(children)
        chosen = [j for j, (gain, _) in halves.items() if gain > 0] or sorted(halves, key=lambda j: (-halves[j][0], j))[: int(cutoff * len(halves))]
        chosen = sorted(chosen)[: most - len(c)]
        if not chosen:
            break
        parts = [child for j in range(len(c)) for child in (halves[j][1] if j in chosen else [c[j]])]
        label, c = local_kmeans(x, np.array(parts), passes)
    return label, c


def xmeans_groups(frames: DataFrame, keys: tuple[str, ...], vector: str, k: int = 1, most: int = 10, passes: int = 300, splits: int | None = None, cutoff: float = 0.0, frame: str = FRAME) -> DataFrame:
    """``keys, cluster_id, frame_id, n``: X-means in each group (a shot), and the frame nearest to each centroid."""
    narrow = frames.select(*keys, frame, vector).filter(F.col(vector).isNotNull())

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame, ignore_index=True)
        x = np.array(pdf[vector].tolist(), float)
        label, c = xmeans(x, k, most, passes, splits, cutoff)
        used = [j for j in range(len(c)) if (label == j).any()]
        near = [int(np.sqrt(((x - c[j]) ** 2).sum(1)).argmin()) for j in used]
        out = pd.DataFrame({q: [v] * len(used) for q, v in zip(keys, key, strict=True)})
        return out.assign(cluster_id=range(len(used)), **{frame: pdf[frame].iloc[near].to_numpy()}, n=[int((label == j).sum()) for j in used])

    kinds = ", ".join(f"`{q}` {narrow.schema[q].dataType.simpleString()}" for q in keys)
    return narrow.groupBy(*keys).applyInPandas(run, f"{kinds}, cluster_id int, `{frame}` {narrow.schema[frame].dataType.simpleString()}, n long")


def greedy_unique(x: np.ndarray, limit: float, metric: str = "l2") -> np.ndarray:
    """Places that stay when, in order, each kept row drops the later ones nearer than ``limit``."""
    alive = np.ones(len(x), bool)
    for i in range(len(x)):
        if alive[i]:
            alive[i + 1 :] &= distance_table(x[i + 1 :], x[i : i + 1], metric)[:, 0] >= limit
    return np.flatnonzero(alive)


def dedup_greedy(frames: DataFrame, vector: str = "hist_norm", limit: float = DEDUP_LIMIT, metric: str = "l2", video: str = VIDEO, frame: str = FRAME) -> DataFrame:
    """``video, frame``: keyframes that are left. The rule depends on order, so each video's keyframes meet in one group:
    there is one a cluster."""
    narrow = frames.select(video, frame, vector)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame, ignore_index=True)
        return pdf.iloc[greedy_unique(np.array(pdf[vector].tolist(), float), limit, metric)][[video, frame]]

    schema = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in (video, frame))
    return narrow.groupBy(video).applyInPandas(run, schema)
