"""Local descriptors and bags of visual words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.functions import color
from framelode.operators.cluster import nearest_centroid

CELL, WINDOW, ORIENTATIONS = 8, 16, 9


def hog(gray: np.ndarray) -> np.ndarray:
    """Histograms of oriented gradients: windows of 16 x 16 at a stride of one cell, one block of 2 x 2 cells each, nine
    unsigned orientations with linear votes, normalised with clipping at 0.2. One row of nine for each cell of a window."""
    g = np.sqrt(gray.astype(float))
    h, w = g.shape
    if h < WINDOW or w < WINDOW:
        return np.zeros((0, ORIENTATIONS))
    padded = np.pad(g, 1, mode="reflect")
    dx, dy = padded[1:-1, 2:] - padded[1:-1, :-2], padded[2:, 1:-1] - padded[:-2, 1:-1]
    size = np.hypot(dx, dy)
    turn = (np.arctan2(dy, dx) % np.pi) / (np.pi / ORIENTATIONS) - 0.5
    low = np.floor(turn).astype(int)
    part = turn - low
    rows, columns = h // CELL, w // CELL
    ys, xs = np.mgrid[: rows * CELL, : columns * CELL]
    cell = (ys // CELL * columns + xs // CELL) * ORIENTATIONS
    size, low, part = (a[: rows * CELL, : columns * CELL] for a in (size, low, part))
    votes = np.bincount((cell + low % ORIENTATIONS).ravel(), (size * (1 - part)).ravel(), rows * columns * ORIENTATIONS)
    votes += np.bincount((cell + (low + 1) % ORIENTATIONS).ravel(), (size * part).ravel(), rows * columns * ORIENTATIONS)
    cells = votes.reshape(rows, columns, ORIENTATIONS)
    # a window's cells: down, then right
    block = np.stack([cells[:-1, :-1], cells[1:, :-1], cells[:-1, 1:], cells[1:, 1:]], 2).reshape(-1, 4 * ORIENTATIONS)
    block = np.minimum(block / (np.linalg.norm(block, axis=1, keepdims=True) + 0.1 * block.shape[1]), 0.2)
    return (block / (np.linalg.norm(block, axis=1, keepdims=True) + 1e-3)).reshape(-1, ORIENTATIONS)


def needs_opencv(name: str) -> Callable[[np.ndarray], np.ndarray]:
    def compute(gray: np.ndarray) -> np.ndarray:
        try:
            import cv2
        except ImportError as e:
            raise RuntimeError(f"descriptor {name!r} needs OpenCV on the executors; register another function for it, or read descriptors from files") from e
        maker = cv2.SIFT_create() if name == "sift" else cv2.xfeatures2d.SURF_create()
        found = maker.detectAndCompute(gray.astype(np.uint8), None)[1]
        return np.zeros((0, 128 if name == "sift" else 64)) if found is None else found

    return compute


#: Descriptor functions by name: gray image to one row a descriptor.
DESCRIPTORS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"hog": hog, "sift": needs_opencv("sift"), "surf": needs_opencv("surf")}


def descriptors(images: DataFrame, kind: str = "hog", keys: tuple[str, ...] = ("video_id", "frame_id")) -> DataFrame:
    """``keys, desc_id, vec`` from frames with ``height, width, data`` (BGR bytes)."""
    compute = DESCRIPTORS[kind]
    narrow = images.select(*keys, "height", "width", "data")
    kinds = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                h, w, data = (b.column(len(keys) + k)[i].as_py() for k in range(3))
                rows = compute(color.gray_image(color.pixels(data, h, w))) if data else np.zeros((0, 1))
                at = pa.array([i] * len(rows), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(at) for k in range(len(keys))), pa.array(range(len(rows)), pa.int32()), pa.array(rows.tolist(), pa.list_(pa.float64()))], [*keys, "desc_id", "vec"])

    return narrow.mapInArrow(scan, f"{kinds}, desc_id int, vec array<double>")


def word_histogram(described: DataFrame, codebook: DataFrame, vector: str = "vec", keys: tuple[str, ...] = ("video_id", "frame_id"), metric: str = "l2") -> DataFrame:
    """``keys, word, cnt``: descriptors of each frame by nearest word; only words that occur."""
    words = nearest_centroid(described.select(*keys, vector), codebook, vector, metric)
    return words.groupBy(*keys, F.col("cluster_id").cast("int").alias("word")).agg(F.count("*").alias("cnt"))


def dense_words(counts: DataFrame, words: int, keys: tuple[str, ...] = ("video_id", "frame_id")) -> DataFrame:
    """``keys, hist``: word counts as one vector a frame, zeros included."""
    return counts.groupBy(*keys).agg(F.array(*(F.sum(F.when(F.col("word") == k, F.col("cnt")).otherwise(0)).cast("double") for k in range(words))).alias("hist"))
