"""Operators against hand-made fixtures and independent numpy forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelode import scratch
from framelode.functions import color, names, vec
from framelode.operators import bovw, cluster, histogram, signal, summary
from framelode.operators.sequence import by_frame, chunked, positions
from framelode.plans import pipelines
from framelode.scratch import purge, release, written


def sequence(spark, values, column="x", kind="double"):
    return spark.createDataFrame([("v", i, v) for i, v in enumerate(values)], f"video_id string, frame_id long, {column} {kind}").repartition(3)


def column(df, name):
    return [r[name] for r in df.orderBy("frame_id").collect()]


@pytest.mark.parametrize(
    ("reach", "x", "want"),
    [(2, [0, 0.1, 0.9, 0.1, 0.05, 0.5, 0.4], [0, 0, 0.888889, 0, 0, 0.2, 0]), (3, [0, 0.2, 0.1, 0.8, 0.1, 0.3], [0, 0, 0, 0.625, 0, 0])],
)
def test_neighbourhood_max(spark, reach, x, want):
    df = sequence(spark, [float(v) for v in x])
    plain = df.withColumn("y", signal.neighbourhood_max(by_frame(), "x", reach))
    cut = chunked(df, lambda w: {"y": signal.neighbourhood_max(w, "x", reach)}, reach, reach - 1, rows=2, span=3)
    assert np.allclose(column(plain, "y"), want, atol=1e-6)
    assert column(cut, "y") == column(plain, "y")


def test_convolution_and_median(spark):
    df = sequence(spark, [1.0, 4.0, 2.0, 7.0])
    assert column(df.withColumn("y", signal.convolve(by_frame(), "x", (1, -1))), "y") == [3, -2, 5, -7]
    assert column(df.withColumn("y", signal.convolve(by_frame(), "x", (1, -2, 1))), "y") == [2, -5, 7, -12]
    m = chunked(sequence(spark, [5.0, 1.0, 4.0, 2.0, 3.0, 9.0, 0.0]), lambda w: {"y": signal.median5(w, "x")}, 0, 4, rows=2, span=4)
    assert column(m, "y") == [3, 3, 3, 0, 0, 0, 0]
    with pytest.raises(ValueError):
        signal.convolve(by_frame(), "x", (1, 2, 3, 4))


def test_positions_of_shuffled_and_sparse_frames(spark):
    ids = [5, 900, 17, 3, 100_000, 44]
    df = spark.createDataFrame([("a", i) for i in ids] + [(None, 7)], "video_id string, frame_id long").repartition(5)
    got = {(r["video_id"], r["frame_id"]): r["pos"] for r in positions(df, span=10).collect()}
    assert got == {("a", i): k for k, i in enumerate(sorted(ids))} | {(None, 7): 0}


def test_spline():
    y = np.array([0, 1, 0, 1, 4, 1, 0, 1.0])
    want = [0.433477, 0.697397, 0.941157, 1.146958, 1.265344, 1.257436, 1.176759, 1.081472]
    got = signal.spline(y, 0.05)
    assert np.allclose(got, want, atol=1e-6) and abs(got.sum() - 8) < 1e-9
    line = np.array([1, 3, 5, 7, 9, 11.0])
    assert np.allclose(signal.spline(line), line) and np.allclose(signal.spline(y, 1), y)
    rng = np.random.default_rng(0)
    y = rng.normal(size=60)
    q = np.diff(np.eye(60), 2, axis=0).T
    r = 4 * np.eye(58) + np.eye(58, k=1) + np.eye(58, k=-1)
    u = np.linalg.solve(6 * 0.95 * q.T @ q + 0.05 * r, q.T @ y)
    assert np.allclose(signal.spline(y, 0.05), y - 6 * 0.95 * q @ u)
    assert signal.spline(np.array([2.0])).tolist() == [2.0]


def test_shots_and_merge(spark):
    mask = [0] + [1] * 12 + [0, 0] + [1] * 5 + [0]
    found = signal.shots(sequence(spark, mask, "effect", "int")).collect()
    assert [(r["shot_id"], r["start_frame"], r["end_frame"]) for r in found] == [(1, 0, 12)]
    open_end = signal.shots(sequence(spark, [0] + [1] * 12, "effect", "int")).collect()
    assert [(r["start_frame"], r["end_frame"]) for r in open_end] == [(0, 12)]
    assert signal.merged([(0, 12), (20, 40), (45, 60), (200, 215)]) == [(0, 60), (200, 215)]
    assert signal.merged([(0, 50), (55, 100), (105, 130)]) == [(0, 50), (55, 130)]
    spans = spark.createDataFrame([("v", 105, 130), ("v", 0, 50), ("v", 55, 100)], "video_id string, start_frame int, end_frame int")
    assert sorted((r["start_frame"], r["end_frame"]) for r in signal.merge_intervals(spans).collect()) == [(0, 50), (55, 130)]


def v_shape(n=25):
    t = np.linspace(-1, 1, 41)
    return np.r_[np.full(n, 1.0), 0.35 + 0.65 * np.sin(np.abs(t) * np.pi / 2) ** 2, np.full(n, 1.0)]


def spans_of(spark, values):
    df = sequence(spark, [float(x) for x in values], "v").withColumn("pos", F.col("frame_id").cast("long"))
    return sorted((r["start_frame"], r["end_frame"]) for r in signal.dissolve_spans(df, "v").collect())


def test_dissolve_spans(spark):
    v = v_shape()
    (found,) = spans_of(spark, v)
    assert found[0] < 45 < found[1] and v[found[0]] > 0.9 and v[found[1]] > 0.9
    assert len(spans_of(spark, np.r_[v, v])) == 2
    assert spans_of(spark, 1 - v) == spans_of(spark, v * 0.2) == spans_of(spark, v[26:]) == []
    assert len(spans_of(spark, v[:64])) == 1  # nothing follows, which counts as a fall to 0
    assert spans_of(spark, np.ones(30)) == spans_of(spark, [1.0]) == []
    flat = np.r_[v[:45], v[45], v[45:]]  # two frames at the bottom
    assert len(spans_of(spark, flat)) == 1


def test_dissolve_is_masked(spark):
    frames = sequence(spark, [float(x) for x in np.r_[v_shape(), np.zeros(5)]], "gray_var").withColumn("dissim", F.lit(0.0))
    ((start, end),) = [(r["start_frame"], r["end_frame"]) for r in signal.dissolves(frames).collect()]
    effect = column(signal.effects(frames), "effect")
    assert effect[0] == 0 and effect[start : end + 1] == [0] * (end + 1 - start) and effect[1:start] == [1] * (start - 1)
    assert column(signal.effects(frames, dissolve=False), "effect")[start : end + 1] == [1] * (end + 1 - start)


def test_spline_in_chunks(spark):
    y = np.random.default_rng(3).normal(size=3000) + np.r_[np.zeros(1500), np.full(1500, 50.0)]
    df = sequence(spark, [float(x) for x in y], "x")
    got = {r["frame_id"]: r["smooth"] for r in signal.smooth(df, "x", rows=700).collect()}
    first = min(got)
    assert np.abs(np.array([got[first + k] for k in range(3000)]) - signal.spline(y)).max() < 1e-9


def test_effects_constant_variance_and_one_frame(spark):
    for n in (1, 3):
        out = signal.effects(sequence(spark, [0.0] * n, "gray_var").withColumn("dissim", F.lit(0.0)))
        assert column(out, "effect") == [0] * n


def test_distances_and_correlation(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 4.0, 6.0]), ([1.0, 0.0, 1.0], [1.0, 1.0, 0.0]), ([0.0, 0.0, 0.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    rows = df.select(vec.cosine_dissimilarity("a", "b").alias("c"), vec.l1("a", "b").alias("l1"), vec.l2("a", "b").alias("l2"), vec.pearson("a", "b").alias("p"), vec.std("a").alias("s"), vec.variance("a", True).alias("v")).collect()
    assert abs(rows[0]["c"]) < 1e-12 and abs(rows[1]["c"] - 0.5) < 1e-12 and rows[2]["c"] is None
    assert rows[0]["l1"] == 6 and abs(rows[0]["l2"] - 14**0.5) < 1e-12
    assert abs(rows[0]["p"] - 1) < 1e-12 and rows[2]["p"] is None
    assert abs(rows[0]["s"] - np.std([1, 2, 3])) < 1e-12 and rows[0]["v"] == 1
    v = df.select(vec.difference("b").alias("d"), vec.scale("a", 2.0).alias("m"), vec.distances("a", F.array("a", "b")).alias("n")).first()
    assert v["d"] == [2, 2] and v["m"] == [2, 4, 6] and v["n"][0] == 0


FIVE = [[1.0, 0.0], [0.8, 0.2], [0.1, 0.9], [0.1, 0.9], [0.6, 0.4]]


def test_estimate_k_and_dedup(spark):
    df = sequence(spark, FIVE, "hist_norm", "array<double>")
    assert cluster.estimate_k(df, rows=2).collect()[0]["k"] == 2
    assert cluster.estimate_k(df, thresholds=(2.0, 0.2)).collect()[0]["k"] == 3
    assert cluster.estimate_k(df.filter("frame_id = 0")).collect()[0]["k"] == 1
    assert sorted(r["frame_id"] for r in cluster.dedup_greedy(df).collect()) == [0, 2, 4]
    gaps = df.withColumn("d", signal.consecutive(by_frame(), "hist_norm", "l1"))
    assert np.allclose(column(gaps, "d")[1:], [0.4, 1.4, 0, 1.0])


def test_kmeans_and_keyframes(spark, monkeypatch):
    points = [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0], [10.0, 10.0], [11.0, 10.0], [10.0, 12.0]]
    df = sequence(spark, points, "hist", "array<double>")
    for group, rows in ((cluster.GROUP_ROWS, 0), (1, cluster.DRIVER_ROWS), (1, 0)):  # grouped, with centroids on the driver, in written tables
        monkeypatch.setattr(cluster, "GROUP_ROWS", group)
        monkeypatch.setattr(cluster, "DRIVER_ROWS", rows)
        found, centroids = cluster.kmeans(df, 2, "hist")
        assert column(found, "cluster_id") == [0, 0, 0, 1, 1, 1]
        assert np.allclose([r["vec"] for r in centroids.orderBy("cluster_id").collect()], [[1 / 3, 1 / 3], [31 / 3, 32 / 3]])
        assert sorted(r["frame_id"] for r in cluster.keyframes(found).collect()) == [0, 3]
    equal = sequence(spark, [[1.0, 1.0]] * 3, "hist", "array<double>")
    found, centroids = cluster.kmeans(equal, 2, "hist")
    assert column(found, "cluster_id") == [0, 0, 0] and centroids.count() == 2
    empty, _ = cluster.kmeans(df.limit(0), 2, "hist")
    assert empty.count() == 0


def test_lbg_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 0.1, (30, 2)) for m in ([0, 0], [5, 0], [0, 5], [5, 5])]) + 1
    df = sequence(spark, x.tolist(), "vec", "array<double>")
    words, n = cluster.lbg(df, "vec", 4)
    assert n.sum() == 120 and sorted(n.tolist()) == [30] * 4
    c = x.mean(0)[None]
    for _ in range(2):
        c = np.concatenate([c * 1.051, c * 0.949])
        label, _ = cluster.nearest_rows(x, c)
        c = np.array([x[label == k].mean(0) if (label == k).any() else c[k] for k in range(len(c))])
    words, _ = cluster.lbg(df, "vec", 4, passes=1)
    assert np.allclose(words, c)
    words, n = cluster.lbg(df.limit(0), "vec", 4)
    assert len(words) == 0


def test_xmeans():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, 0.2, (40, 3)) for m in (0, 5, 10)])
    label, c = cluster.xmeans(x, 1, 10)
    assert len(c) == 3 and sorted(np.bincount(label)) == [40, 40, 40]
    assert len(cluster.xmeans(np.ones((5, 2)))[1]) == 1 and len(cluster.xmeans(np.ones((1, 2)))[1]) == 1


def test_word_histogram_sums(spark):
    d = spark.createDataFrame([("v", f, k, [float(k), 0.0]) for f in range(3) for k in range(4)], "video_id string, frame_id int, desc_id int, vec array<double>")
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 0.0])], "cluster_id int, vec array<double>")
    counts = bovw.word_histogram(d, book)
    assert {(r["frame_id"], r["word"]): r["cnt"] for r in counts.collect()} == {(f, w): 2 for f in range(3) for w in (0, 1)}
    assert [r["hist"] for r in bovw.dense_words(counts, 3).collect()] == [[2.0, 2.0, 0.0]] * 3


def test_hog():
    ramp = np.tile(np.arange(32) * 8.0, (24, 1))
    rows = bovw.hog(ramp)
    assert rows.shape == (3 * 2 * 4, 9)
    assert (rows.argmax(1) % 8 == 0).all()  # horizontal gradients vote for the first and last orientation
    assert bovw.hog(np.zeros((8, 8))).shape == (0, 9)
    with pytest.raises(RuntimeError):
        bovw.DESCRIPTORS["sift"](ramp)


def test_images(spark):
    red, gray = bytes([0, 0, 255] * 4), bytes([128] * 12)
    df = spark.createDataFrame([("v", 1, 2, 2, bytearray(red)), ("v", 2, 2, 2, bytearray(gray)), ("v", 3, 0, 0, None)], "video_id string, frame_id int, height int, width int, data binary")
    rows = histogram.image_features(df).orderBy("frame_id").collect()
    assert rows[0]["hist"][15] == 4 and rows[0]["hist"][16] == 4 and rows[0]["n_pixels"] == 4 and rows[0]["gray_var"] == 0
    assert rows[1]["hist"][8] == 4 and rows[2]["hist"] is None
    v = histogram.image_features(df, "hsv").orderBy("frame_id").select(histogram.value_channel(F.col("hist")).alias("v")).collect()
    assert v[0]["v"][15] == 4 and v[1]["v"][8] == 4
    rng = np.random.default_rng(4)
    bgr = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    flat = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(bgr.reshape(-1, 3))], "i int, b int, g int, r int")
    got = flat.select("i", color.hsv(F.col("r"), F.col("g"), F.col("b")).alias("x")).orderBy("i").select("x.*").collect()
    assert np.array_equal([list(r) for r in got], color.hsv_image(bgr).reshape(-1, 3))


def test_histograms(spark):
    px = spark.createDataFrame([("v", 1, 0, 3), ("v", 1, 0, 250), ("v", 1, 1, 17), ("v", 2, 0, 16)], "video_id string, frame_id int, channel int, value int")
    rows = histogram.from_long(px, F.col("value"), channel="channel", channels=2).orderBy("frame_id").collect()
    assert rows[0]["hist"][0] == 1 and rows[0]["hist"][15] == 1 and rows[0]["hist"][17] == 1 and sum(rows[0]["hist"]) == 3
    t = spark.createDataFrame([("aé\n€😀",), ("",), (None,)], "t string")
    got = histogram.with_norm(histogram.from_text(t.withColumn("i", F.lit(1)), "t")).collect()
    assert got[0]["n_pixels"] == 5 and got[0]["hist"][0] == 1 and got[0]["hist"][6] == 1 and got[0]["hist"][14] == 1 and got[0]["hist"][15] == 2
    assert got[1]["n_pixels"] == 0 and got[1]["hist_norm"] is None and got[2]["hist"] is None and got[2]["n_pixels"] is None
    hue = spark.createDataFrame([([1.0] * 180,)], "h array<double>").select(histogram.hue_histogram(F.col("h")).alias("x")).first()["x"]
    assert hue == [16.0] * 11 + [4.0] + [0.0] * 4


def test_summary_filters(spark):
    alike, other = [4.0, 1.0, 1.0], [0.0, 9.0, 1.0]
    df = sequence(spark, [alike, alike, other], "rgb", "array<double>").withColumn("hue_norm", F.col("rgb")).withColumn("gray_var", F.col("frame_id") * 700.0)
    assert sorted(r["frame_id"] for r in summary.pair_filter(df, pixels=None).collect()) == [1, 2]
    assert [r["frame_id"] for r in summary.low_variance_filter(df).collect()] == [2]
    assert summary.summary_frames(df, df.filter("frame_id > 0").union(df)).count() == 3


def test_names(spark):
    df = spark.createDataFrame([("/x/v7_30_320x240.avi",), ("/x/v8_2_a_640x480.avi",), ("/x/plain.avi",)], "path string")
    rows = df.select(names.video_attributes(names.simple_name(F.col("path"))).alias("a")).select("a.*").collect()
    assert [tuple(r) for r in rows] == [(30, "320x240"), (2, "640x480"), (None, None)]
    one = spark.range(1).select(names.frame_name(F.lit(7)).alias("f"), names.seconds_text(F.lit(None)).alias("s"), names.feature_text(F.array(F.lit(0.5), F.lit(2.0))).alias("t")).first()
    assert tuple(one) == ("frame-000007.jpg", "-1.0000", "0.500000 2.000000 ")


@pytest.mark.parametrize("rows", [cluster.GROUP_ROWS, 1])
def test_kmeans_variants(spark, monkeypatch, rows):
    """Clusters without frames are kept or dropped, clusters of one frame move or stay: in one task and in one job a pass."""
    monkeypatch.setattr(cluster, "GROUP_ROWS", rows)
    values = [[0.0, 0.0], [0.0, 0.0], [9.0, 9.0], [9.0, 10.0], [30.0, 30.0]]  # the second seed never wins
    df = sequence(spark, values, "hist", "array<double>")
    kept = {r["cluster_id"]: r["vec"] for r in cluster.kmeans(df, 3)[1].collect()}
    assert kept == {0: [0, 0], 1: [0, 0], 2: [16, pytest.approx(49 / 3)]}
    found, centroids = cluster.kmeans(df, 3, empty="drop")
    assert sorted(r["cluster_id"] for r in centroids.collect()) == [0, 2] and column(found, "cluster_id") == [0, 0, 2, 2, 2]
    lone = sequence(spark, [[0.0], [10.0], [10.0], [3.0]], "hist", "array<double>")
    assert {r["cluster_id"]: r["vec"] for r in cluster.kmeans(lone, 2, max_passes=1)[1].collect()} == {0: [1.5], 1: [10]}
    far = sequence(spark, [[0.0], [10.0], [10.0], [9.0]], "hist", "array<double>")
    two = far.withColumn("hist", F.when(F.col("frame_id") == 0, F.array(F.lit(0.5))).otherwise(F.col("hist")))
    for single in (True, False):
        assert {r["cluster_id"]: r["vec"][0] for r in cluster.kmeans(two, 2, single=single)[1].collect()} == {0: 0.5, 1: pytest.approx(29 / 3)}


def test_nearest_rows_in_pieces():
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(300, 7)), rng.normal(size=(40, 7))
    for metric in ("l1", "l2"):
        whole, pieces = cluster.nearest_rows(x, c, metric), cluster.nearest_rows(x, c, metric, cells=1)
        assert np.array_equal(whole[0], pieces[0]) and np.array_equal(whole[1], pieces[1])


def test_distances_are_summed_in_order():
    rng = np.random.default_rng(6)
    x, c = rng.random((40, 19)), rng.random((5, 19))
    for metric in ("l1", "l2"):
        for p, row in zip(x, cluster.distance_table(x, c, metric), strict=True):
            for q, got in zip(c, row, strict=True):
                want = 0.0
                for u, v in zip(p, q, strict=True):
                    want += abs(u - v) if metric == "l1" else (u - v) * (u - v)
                assert got == (want if metric == "l1" else np.sqrt(want))


def test_xmeans_rounds():
    x = np.concatenate([np.random.default_rng(k).normal(size=(40, 2)) * 0.1 + np.array([9 * (k % 2) + 90 * (k // 2), 0]) for k in range(4)])
    assert len(cluster.xmeans(x)[1]) == 4 and len(cluster.xmeans(x, splits=1)[1]) == 2 and len(cluster.xmeans(x, most=3)[1]) == 3
    ball = np.random.default_rng(9).normal(size=(60, 2))
    assert len(cluster.xmeans(ball)[1]) == 1 < len(cluster.xmeans(ball, cutoff=1.0, splits=1)[1])


def test_presets(spark):
    rng = np.random.default_rng(2)
    images = [("v", k, 6, 6, rng.integers(0, 256, 108, np.uint8).tobytes()) for k in range(4)] + [("v", 4, 6, 6, bytes(108))]
    df = spark.createDataFrame(images, "video_id string, frame_id int, height int, width int, data binary")
    for name, p in pipelines.PRESETS.items():
        f = pipelines.image_frames(df, name)
        for r in f.collect():
            h = np.array(r[p.filter_column])
            assert len(h) == p.bins and len(r["hist"]) == 16 and sum(r["hist"]) == 36
        value = {"std": lambda h: h.std(), "fixed_mean": lambda h: np.sqrt(((h - 1 / 16) ** 2).sum() / 16), "root_squares": lambda h: np.sqrt((h * h).sum())}[p.spread]
        want = sorted(r["frame_id"] for r in f.collect() if value(np.array(r[p.filter_column])) <= p.max_std)
        got = sorted(r["frame_id"] for r in histogram.meaningful(f, p.max_std, p.spread, p.filter_column).collect())
        assert got == want and 4 not in got, name
        assert {r["frame_id"] for r in pipelines.histogram_summary(f, name).collect()} <= set(want)
    frames = spark.range(100).select(F.col("id"))
    assert pipelines.PRESETS["gpu"].sampled(frames, F.col("id"), 10.0).count() == 4 and pipelines.PRESETS["cpu"].sampled(frames, F.col("id"), 10.0).count() == 10


def test_scratch(spark):
    mine = f"{scratch.checkpoint_root(spark)}/others.parquet"
    spark.range(3).write.parquet(mine)
    df = written(spark.range(5), "numbers")
    since = len(scratch.CREATED)
    first, last = written(spark.range(6), "first"), written(spark.range(7), "last")
    release(spark, since, keep=1)
    assert df.count() == 5 and last.count() == 7
    with pytest.raises(Exception):
        first.count()
    purge(spark)
    with pytest.raises(Exception):
        df.count()
    assert spark.read.parquet(mine).count() == 3  # what others keep in the folder stays
