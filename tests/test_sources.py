"""Sources, sinks, streaming and the entry module."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from framelode.sources import frames, sinks
from framelode.streaming import frames as stream


def png(path, pixels):
    raw = b"".join(b"\0" + bytes(sum(row, [])) for row in pixels)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(pixels[0]), len(pixels), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_read_images(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    png(tmp_path / "v1" / "frame-000003.png", [[[255, 0, 0], [0, 255, 0]]])
    (row,) = frames.read_images(spark, str(tmp_path)).collect()
    assert (row["video_id"], row["frame_id"], row["height"], row["width"], bytes(row["data"])) == ("v1", 3, 1, 2, bytes([0, 0, 255, 0, 255, 0]))


def test_videos_and_decode(spark, tmp_path):
    for n in ("b_2_x_320.avi", "a_30_640.avi", "c.txt"):
        (tmp_path / n).write_text("x")
    videos = frames.list_videos(spark, str(tmp_path))
    assert [(r["video_id"], r["length"], r["resolution"]) for r in videos.collect()] == [("a_30_640", 30, "640"), ("b_2_x_320", 2, "320")]
    decoder = lambda path: ((i, 1, 1, bytes([i, i, i])) for i in range(10))
    got = frames.decode(videos, decoder, every=3, ranges=2)
    assert sorted((r["video_id"][0], r["frame_id"], r["data"][0]) for r in got.collect()) == [(v, k + 1, 3 * k) for v in "ab" for k in range(4)]
    calls = spark.sparkContext.accumulator(0)

    def seeking(path, part, parts):
        for i in range(10 * part // parts, 10 * (part + 1) // parts):
            calls.add(1)
            yield i, 1, 1, bytes([i, i, i])

    sought = frames.decode(videos, seeking, every=3, ranges=4, seeks=True, batch=2).collect()
    assert sorted(map(tuple, sought)) == sorted(map(tuple, got.collect())) and calls.value == 20  # each frame is decoded once
    assert [r["frame_id"] for r in frames.sampled(spark.range(10), F.col("id"), 4.9).orderBy("id").collect()] == [1, 2, 3]
    frames.discard(got)


def test_matrices(spark, tmp_path):
    (tmp_path / "f1.feat").write_text("1.000000 2.500000 \n3 4 \n")
    (tmp_path / "f2.feat").write_text("5 6 \n")
    got = sorted((r["frame"], r["vec"]) for r in frames.read_matrix(spark, str(tmp_path)).collect())
    assert got == [("f1", [1.0, 2.5]), ("f1", [3.0, 4.0]), ("f2", [5.0, 6.0])]
    (tmp_path / "c.out").write_text("1,2\n3, 4\n")
    assert sorted(r["vec"] for r in frames.read_centres(spark, str(tmp_path / "c.out")).collect()) == [[1, 2], [3, 4]]


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "summaries")
    df = spark.createDataFrame([(v, i) for v in "ab" for i in range(4)], "video_id string, frame_id int")
    videos = df.select("video_id").distinct()
    assert sinks.to_summarize(videos, out).count() == 2
    sinks.write_summary(df, df.filter("video_id = 'a' AND frame_id > 1"), out)
    assert spark.read.parquet(out).count() == 2
    assert [r["video_id"] for r in sinks.to_summarize(videos, out).collect()] == ["b"]
    sinks.write_summary(df, df.filter("video_id = 'b' AND frame_id = 0"), out)
    assert spark.read.parquet(out).count() == 3
    metrics = sinks.RunMetrics()
    assert metrics.timed("read", df.count) == 8
    metrics.rows.append(("spark", "v", 2, "320", "never", None))
    metrics.write(spark, str(tmp_path / "m"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "m")).collect())
    assert lines[0].startswith('spark;"";') and lines[1] == "spark;v;2;320;never;-1.0000"
    assert sinks.copy(spark, out, f"{tmp_path}/copies/of") and spark.read.parquet(f"{tmp_path}/copies/of").count() == 3
    assert sinks.make_folder(spark, f"{tmp_path}/new/folder") and (tmp_path / "new" / "folder").is_dir()
    assert sinks.remove(spark, out)
    d = spark.createDataFrame([("v", 1, 0, [0.5, 1.0])], "video_id string, frame_id int, desc_id int, vec array<double>")
    sinks.write_descriptors(d, str(tmp_path / "d"))
    sinks.write_descriptors(d, str(tmp_path / "t"), text=True)
    assert spark.read.text(str(tmp_path / "t")).first()["value"] == "0.500000 1.000000 "
    sinks.append_text(d.select("video_id"), "video_id", str(tmp_path / "a"))


def test_streaming_jumps(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("v", i, h) for i, h in enumerate([[1.0, 0.0], [0.8, 0.2], [0.1, 0.9], [0.1, 0.9], [0.6, 0.4]])]
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, stream.FEATURES).coalesce(1).write.mode("append").parquet(src)
    q = stream.jumps(stream.read_features(spark, src)).writeStream.format("memory").queryName("jumps").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = [(r["frame_id"], r["k"]) for r in spark.sql("SELECT * FROM jumps ORDER BY frame_id").collect()]
    assert got == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]


def test_entry_and_oracles():
    entry = pytest.importorskip("__spark_entry__")
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 40
