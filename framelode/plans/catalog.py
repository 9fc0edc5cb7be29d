"""Registered queries and their DuckDB oracles.

Every query runs over its whole table. Frames come from the proxies of ``framelode.sources.proxies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelode.functions import color, names, vec
from framelode.operators import bovw, cluster, histogram, signal, summary
from framelode.operators.sequence import chunked
from framelode.plans import pipelines
from framelode.sources import frames as source
from framelode.sources import proxies

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
CUT_HERE, K, JUMP, NEAR = 0.02, 3, 1.4, 1.2


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def v6(c: Column | str) -> Column:
    """Six decimals of a variance: many are dyadic fractions, and a tie must not turn on the order of a sum."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxies.event_signals(spark, sf_dir, EVENT_TYPES)


def with_dissimilarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.segmentation_signals(signals(spark, sf_dir))


# Oracle parts -----------------------------------------------------------------------------------

DOC = """px AS (SELECT source AS video_id, doc_id AS frame_id, unnest(string_split(text, '')) AS ch FROM documents),
cnt AS (SELECT video_id, frame_id, CAST(floor(least(unicode(ch), 255) / 16) AS INT) AS bin, count(*) AS c FROM px WHERE ch <> '' GROUP BY ALL),
doc AS (SELECT source AS video_id, doc_id AS frame_id, length(text) AS n_pixels FROM documents),
dense AS (SELECT d.video_id, d.frame_id, d.n_pixels, b.bin, coalesce(c.c, 0) AS c FROM doc d CROSS JOIN (SELECT unnest(range(16)) AS bin) b
  LEFT JOIN cnt c ON c.video_id = d.video_id AND c.frame_id = d.frame_id AND c.bin = b.bin),
norm AS (SELECT video_id, frame_id, n_pixels, list(CAST(c AS DOUBLE) / n_pixels ORDER BY bin) AS h, list(CAST(c AS DOUBLE) ORDER BY bin) AS raw FROM dense WHERE n_pixels > 0 GROUP BY ALL)"""
EMB = "emb AS (SELECT label AS video_id, vec_id AS frame_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
EVT = f"""ev AS (SELECT 'events' AS video_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame_id, event_type, CAST(least(255, floor(value)) AS INT) AS gray FROM events),
sig AS (SELECT video_id, frame_id, var_pop(gray) AS gray_var, [{", ".join(f"CAST(count(*) FILTER (WHERE event_type = '{t}' AND gray // 16 = {k}) AS DOUBLE)" for t in EVENT_TYPES for k in range(16))}] AS hist FROM ev GROUP BY ALL),
dis AS (SELECT *, CASE WHEN lag(1) OVER w IS NULL THEN 0.0 ELSE coalesce(1 - list_cosine_similarity(hist, lead(hist) OVER w), 0.0) END AS dissim FROM sig WINDOW w AS (PARTITION BY video_id ORDER BY frame_id))"""
W = "(PARTITION BY video_id ORDER BY frame_id)"


def filtered(x: str, reach: int) -> str:
    m = f"greatest(coalesce(max({x}) OVER (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN {reach} PRECEDING AND 1 PRECEDING), 0.0), coalesce(max({x}) OVER (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN 1 FOLLOWING AND {reach - 1} FOLLOWING), 0.0), 0.0)"
    return f"CASE WHEN {x} > {m} THEN ({x} - {m}) / {x} ELSE 0.0 END"


def over(order: str) -> str:
    return f"OVER (PARTITION BY video_id ORDER BY frame_id{order})"


def spline_of(source: str) -> str:
    """CTEs (recursive): ``sm``, the smoothing spline ``v`` of ``source (video_id, frame_id, y)`` by elimination of the five bands, a row at a time, and back."""
    p = 0.05
    d, e, f = 36 * (1 - p) + 4 * p, p - 24 * (1 - p), 6 * (1 - p)
    return f"""ys AS (SELECT video_id, frame_id, CAST(y AS DOUBLE) AS y, row_number() {over("")} - 1 AS k, count(*) OVER (PARTITION BY video_id) AS n, lead(y, 2) {over("")} - 2 * lead(y) {over("")} + y AS b FROM {source}),
el AS (SELECT video_id, 0::BIGINT AS k, {d}::DOUBLE AS d, 0::DOUBLE AS dp, 0::DOUBLE AS low1, 0::DOUBLE AS low2, b AS u, 0::DOUBLE AS up FROM ys WHERE k = 0 AND n > 2
  UNION ALL SELECT video_id, k, {d} - low2 * {f} - low1 * cr, dp, low1, low2, b - low1 * u - low2 * up, u FROM (SELECT *, cr / dp AS low1 FROM (SELECT y.video_id, y.k, y.b, el.d AS dp, el.u, el.up, CASE WHEN y.k > 1 THEN {f} / el.dp ELSE 0 END AS low2, {e} - (CASE WHEN y.k > 1 THEN {f} * el.low1 ELSE 0 END) AS cr FROM el JOIN ys y ON y.video_id = el.video_id AND y.k = el.k + 1 WHERE y.k < y.n - 2))),
bk AS (SELECT e.video_id, e.k, e.u / e.d AS x, 0::DOUBLE AS xn, e.low1, 0::DOUBLE AS low2n, e.low2 FROM el e JOIN ys y ON y.video_id = e.video_id AND y.k = e.k WHERE e.k = y.n - 3
  UNION ALL SELECT e.video_id, e.k, e.u / e.d - b.low1 * b.x - b.low2n * b.xn, b.x, e.low1, b.low2, e.low2 FROM bk b JOIN el e ON e.video_id = b.video_id AND e.k = b.k - 1),
sm AS (SELECT y.video_id, y.frame_id, y.k, y.n, y.y - {f} * (coalesce(a.x, 0) - 2 * coalesce(b.x, 0) + coalesce(c.x, 0)) AS v FROM ys y LEFT JOIN bk a ON a.video_id = y.video_id AND a.k = y.k LEFT JOIN bk b ON b.video_id = y.video_id AND b.k = y.k - 1 LEFT JOIN bk c ON c.video_id = y.video_id AND c.k = y.k - 2)"""


def merged_of(source: str, out: str) -> str:
    """CTEs (recursive): ``out``, the merged intervals of ``source (video_id, start_frame, end_frame)``."""
    fits = "g.end_frame + 10 >= t.start_frame AND g.acc + t.end_frame - t.start_frame < 90"
    return f"""{out}_o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_frame, end_frame) AS i FROM {source}),
{out}_g AS (SELECT video_id, i, start_frame, end_frame, end_frame - start_frame AS acc, start_frame AS s FROM {out}_o WHERE i = 1
UNION ALL SELECT t.video_id, t.i, t.start_frame, t.end_frame, CASE WHEN {fits} THEN g.acc + t.end_frame - t.start_frame ELSE t.end_frame - t.start_frame END, CASE WHEN {fits} THEN g.s ELSE t.start_frame END FROM {out}_g g JOIN {out}_o t ON t.video_id = g.video_id AND t.i = g.i + 1),
{out} AS (SELECT video_id, s AS start_frame, max(end_frame) AS end_frame FROM {out}_g GROUP BY video_id, s)"""


def slopes_of(source: str) -> str:
    """CTEs (recursive): ``sg``, slopes and turns of the smoothed median variance of ``source (video_id, frame_id, var)``."""
    five = "ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING"
    return f"""rt AS (SELECT video_id, frame_id, coalesce(var / nullif(max(var) OVER (PARTITION BY video_id), 0), 0) AS x FROM {source}),
md AS (SELECT video_id, frame_id, CASE WHEN count(*) {over(" " + five)} = 5 THEN median(x) {over(" " + five)} ELSE 0.0 END AS y FROM rt),
{spline_of("md")},
sl AS (SELECT *, lead(v, 1, 0) {over("")} - v AS rise, lead(v, 1, 0) {over("")} - 2 * v + lag(v, 1, 0) {over("")} AS bend FROM sm),
sg AS (SELECT *, CASE WHEN rise > 0 THEN 1 WHEN rise < 0 THEN -1 ELSE 0 END AS sgn, coalesce(lag(rise) {over("")} <= 0, true) AS fresh, lag(rise, 2) {over("")} < 0 AND lag(rise) {over("")} < 0 AND rise >= 0 AND lead(rise) {over("")} > 0 AND lead(rise, 2) {over("")} > 0 AND k >= 2 AND k < n - 2 AS turn FROM sl)"""


def dissolved_of(source: str) -> str:
    """CTEs (recursive): ``dissolved``, the merged dissolves of ``source (video_id, frame_id, var)``."""
    side = "{'bend': bend, 'near': k * sgn, 'at': k, 'value': v, 'id': frame_id}"
    turn = "{'bend': 0::DOUBLE, 'near': t.k, 'at': t.k, 'value': t.v, 'id': t.frame_id}"
    return f"""{slopes_of(source)},
rr AS (SELECT *, k - row_number() OVER (PARTITION BY video_id, sgn ORDER BY frame_id) AS run FROM sg),
rn AS (SELECT video_id, sgn, run, min(k) AS first, max(k) AS last, min({side}) FILTER (WHERE bend < 0) AS whole, min({side}) FILTER (WHERE bend < 0 AND NOT fresh) AS rest FROM rr GROUP BY ALL),
vs AS (SELECT t.video_id, t.v, t.n, l.first AS fall_first, r.last AS rise_last, coalesce(l.whole, {turn}) AS a, coalesce(CASE WHEN t.rise = 0 THEN r.whole ELSE r.rest END, {turn}) AS b FROM sg t JOIN rn l ON l.video_id = t.video_id AND l.sgn = -1 AND l.last = t.k - 1 JOIN rn r ON r.video_id = t.video_id AND r.sgn = 1 AND r.first = t.k + CASE WHEN t.rise = 0 THEN 1 ELSE 0 END WHERE t.turn),
sp AS (SELECT vs.video_id, a.id AS start_frame, b.id AS end_frame FROM vs JOIN sm ON sm.video_id = vs.video_id AND sm.k = (a.at + b.at) // 2 WHERE fall_first > 0 AND rise_last < vs.n - 1 AND b.at - a.at > 10 AND vs.v > 0.1 AND a.value >= 0 AND b.value >= 0 AND abs(sm.v - (a.value + b.value) / 4) < 0.7 * sqrt(a.value) * sqrt(b.value) / 2),
{merged_of("sp", "dissolved")}"""


EFFECTS = f"""f AS (SELECT video_id, frame_id, CASE WHEN row_number() OVER {W} = 1 THEN 0.0 ELSE gray_var END AS var, {filtered("dissim", 20)} AS f20 FROM dis),
{dissolved_of("f")},
eff AS (SELECT video_id, frame_id, CASE WHEN coalesce(var / nullif(max(var) OVER (PARTITION BY video_id), 0), 0) < 0.1 OR f20 > {CUT_HERE} OR EXISTS (SELECT 1 FROM dissolved x WHERE x.video_id = f.video_id AND f.frame_id BETWEEN x.start_frame AND x.end_frame) THEN 0 ELSE 1 END AS effect FROM f)"""
SHOTS = f"""run AS (SELECT video_id, frame_id, row_number() OVER {W} - row_number() OVER (PARTITION BY video_id, effect ORDER BY frame_id) AS run, effect FROM eff),
isl AS (SELECT video_id, min(frame_id) - 1 AS start_frame, max(frame_id) AS end_frame FROM run WHERE effect = 1 GROUP BY video_id, run),
shots AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_frame) AS shot_id, start_frame, end_frame FROM isl WHERE end_frame - start_frame > 10)"""


def passes(n: int) -> str:
    """CTEs of n k-means passes on the vectors, seeds first; the last is c<n>."""
    out = [EMB, f"c0 AS (SELECT video_id, cluster_id, v FROM (SELECT video_id, v, row_number() OVER {W} - 1 AS cluster_id FROM emb) WHERE cluster_id < {K})"]
    for k in range(n):
        out.append(assigned(k))
        means = ", ".join(f"avg(v[{j + 1}])" for j in range(64))
        out.append(f"m{k} AS (SELECT video_id, cluster_id, [{means}] AS v FROM a{k} GROUP BY ALL)")
        out.append(f"c{k + 1} AS (SELECT c.video_id, c.cluster_id, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (video_id, cluster_id))")
    return ", ".join([*out, assigned(n)])


def assigned(k: int) -> str:
    return f"a{k} AS (SELECT video_id, frame_id, v, cluster_id, dist FROM (SELECT e.video_id, e.frame_id, e.v, c.cluster_id, list_distance(e.v, c.v) AS dist, row_number() OVER (PARTITION BY e.video_id, e.frame_id ORDER BY list_distance(e.v, c.v), c.cluster_id) AS rn FROM emb e JOIN c{k} c ON c.video_id = e.video_id) WHERE rn = 1)"


# Histograms ---------------------------------------------------------------------------------------


@query(f"WITH {DOC} SELECT video_id, frame_id, n_pixels, CAST(bin AS INT) AS bin, CAST(c AS BIGINT) AS cnt, round(CAST(c AS DOUBLE) / nullif(n_pixels, 0), 6) AS share FROM dense")
def hist16(spark, sf_dir):
    d = proxies.documents(spark, sf_dir)
    long = d.select("video_id", "frame_id", "n_pixels", F.posexplode("hist").alias("bin", "c"))
    return long.select("video_id", "frame_id", "n_pixels", "bin", F.col("c").cast("long").alias("cnt"), F.when(F.col("n_pixels") > 0, r6(F.col("c") / F.col("n_pixels"))).alias("share"))


@query(f"WITH {DOC} SELECT video_id, frame_id, round(stddev_pop(CAST(c AS DOUBLE) / n_pixels), 6) AS std FROM dense WHERE n_pixels > 0 GROUP BY ALL HAVING stddev_pop(CAST(c AS DOUBLE) / n_pixels) < 0.23")
def hist_std_filter(spark, sf_dir):
    return histogram.meaningful(proxies.documents(spark, sf_dir)).select("video_id", "frame_id", r6("std").alias("std"))


@query(f"WITH {DOC} SELECT video_id, frame_id, round(sqrt(list_sum([(x - 0.0625) * (x - 0.0625) for x in h]) / 16), 6) AS deviation FROM norm")
def fixed_mean_deviation(spark, sf_dir):
    d = proxies.documents(spark, sf_dir).filter("n_pixels > 0")
    return d.select("video_id", "frame_id", r6(histogram.fixed_mean_std(F.col("hist_norm"))).alias("deviation"))


@query("WITH ev AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame_id, CAST(least(255, floor(value)) AS INT) AS gray FROM events), c AS (SELECT frame_id, gray // 16 AS bin, count(*) AS c FROM ev GROUP BY ALL) SELECT f.frame_id, b.bin, coalesce(c.c, 0) AS cnt FROM (SELECT DISTINCT frame_id FROM ev) f CROSS JOIN (SELECT unnest(range(16)) AS bin) b LEFT JOIN c ON c.frame_id = f.frame_id AND c.bin = b.bin")
def hist256_folded(spark, sf_dir):
    wide = histogram.from_long(proxies.event_pixels(spark, sf_dir), F.col("gray"), 256, 1)
    return wide.select("frame_id", F.posexplode(histogram.fold(F.col("hist"))).alias("bin", "c")).select("frame_id", F.col("bin").cast("long").alias("bin"), F.col("c").cast("long").alias("cnt"))


@query("WITH ev AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame_id, CAST(least(255, floor(value)) AS INT) AS gray FROM events) SELECT frame_id, count(*) AS n_pixels, round(avg(gray) + 1e-9::DOUBLE, 6) AS gray_mean, round(var_pop(gray) + 1e-9::DOUBLE, 6) AS gray_var, round(var_samp(gray) + 1e-9::DOUBLE, 6) AS gray_var_samp FROM ev GROUP BY ALL")
def gray_variance(spark, sf_dir):
    s = histogram.gray_statistics(proxies.event_pixels(spark, sf_dir), F.col("gray"))
    return s.select("frame_id", "n_pixels", *(v6(c).alias(c) for c in ("gray_mean", "gray_var", "gray_var_samp")))


RGB = {"r": "(p_partkey * 7 + p_size * 5) % 256", "g": "(p_partkey * 13 + p_size) % 256", "b": "(p_partkey * 29) % 256"}
PIXEL = f"p AS (SELECT p_partkey AS pixel, {', '.join(f'CAST({e} AS INT) AS {c}' for c, e in RGB.items())} FROM part)"


def part_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pixel"), *(F.expr(e).cast("int").alias(c) for c, e in RGB.items()))


HSV = """m AS (SELECT *, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM p), t AS (SELECT *, CASE WHEN hi = lo THEN 0.0 WHEN hi = r THEN (g - b) * 60.0 / (hi - lo) WHEN hi = g THEN 120 + (b - r) * 60.0 / (hi - lo) ELSE 240 + (r - g) * 60.0 / (hi - lo) END AS turn FROM m),
hsv AS (SELECT pixel, CAST(round((CASE WHEN turn < 0 THEN turn + 360 ELSE turn END) / 2) % 180 AS INT) AS h, CAST(CASE WHEN hi > 0 THEN round((hi - lo) * 255.0 / hi) ELSE 0 END AS INT) AS s, hi AS v FROM t)"""


@query(f"WITH {PIXEL}, {HSV} SELECT * FROM hsv")
def hsv_pixels(spark, sf_dir):
    return part_pixels(spark, sf_dir).select("pixel", color.hsv(F.col("r"), F.col("g"), F.col("b")).alias("x")).select("pixel", "x.h", "x.s", "x.v")


@query(f"WITH {PIXEL} SELECT pixel, CAST(round(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) AS INT) AS gray FROM p")
def gray_pixels(spark, sf_dir):
    return part_pixels(spark, sf_dir).select("pixel", color.gray(F.col("r"), F.col("g"), F.col("b")).alias("gray"))


@query("WITH n AS (SELECT o_orderkey AS k, 'v' || o_orderkey || '_' || (CASE WHEN o_orderkey % 3 = 0 THEN 30 ELSE o_orderkey % 9 END) || '_' || lower(o_orderstatus) || '_320x240.avi' AS name FROM orders) SELECT k, split_part(split_part(name, '.', 1), '_', 1) AS video, CAST(split_part(name, '_', 2) AS INT) AS length, CASE WHEN split_part(name, '_', 2) = '30' THEN split_part(name, '_', 3) ELSE split_part(split_part(name, '.', 1), '_', 4) END AS resolution, printf('%.4f', CAST(k AS DOUBLE) / 8) AS seconds FROM n WHERE CAST(split_part(name, '_', 2) AS INT) <= 5 OR split_part(name, '_', 2) = '30'")
def name_attributes(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.expr("'/videos/v' || o_orderkey || '_' || (CASE WHEN o_orderkey % 3 = 0 THEN 30 ELSE o_orderkey % 9 END) || '_' || lower(o_orderstatus) || '_320x240.avi'").alias("path"))
    name = names.simple_name(F.col("path"))
    a = o.select("k", F.split(name, "_")[0].alias("video"), names.video_attributes(name).alias("a"), names.seconds_text(F.col("k") / 8).alias("seconds"))
    out = a.select("k", "video", "a.length", "a.resolution", "seconds")
    return summary.short_videos(out).unionByName(out.filter("length = 30"))


@query("SELECT user_id AS video_id, CAST(event_id // 25 + 1 AS INT) AS frame_id, event_id FROM events WHERE event_id % 25 = 0")
def sampled_frames(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("video_id"), "event_id")
    return source.sampled(e, F.col("event_id"), 25.9).select("video_id", "frame_id", "event_id")


@query(f"WITH {PIXEL}, {HSV}, f AS (SELECT p_size AS frame_id, h // 16 AS bin, count(*) AS c FROM hsv JOIN part ON p_partkey = pixel GROUP BY ALL) SELECT d.frame_id, CAST(b.bin AS INT) AS bin, coalesce(c, 0) AS cnt FROM (SELECT DISTINCT p_size AS frame_id FROM part) d CROSS JOIN (SELECT unnest(range(16)) AS bin) b LEFT JOIN f ON f.frame_id = d.frame_id AND f.bin = b.bin")
def hue_histogram(spark, sf_dir):
    """Parts are pixels, a size is a frame: 180 hue counts, 16 bins of width 16."""
    size = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("frame_id"))
    pixels = part_pixels(spark, sf_dir).join(size, F.col("pixel") == F.col("key")).withColumn("h", color.hsv(F.col("r"), F.col("g"), F.col("b"))["h"])
    hues = histogram.from_long(pixels, F.col("h"), 180, 1, ("frame_id",))
    return hues.select("frame_id", F.posexplode(histogram.hue_histogram(F.col("hist"))).alias("bin", "c")).select("frame_id", "bin", F.col("c").cast("long").alias("cnt"))


@query("SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame_id, CAST(least(255, floor(value)) AS INT) AS bin, count(*) AS cnt FROM events GROUP BY ALL")
def hist256(spark, sf_dir):
    """The bins that occur of 256."""
    wide = histogram.from_long(proxies.event_pixels(spark, sf_dir), F.col("gray"), 256, 1)
    return wide.select("frame_id", F.posexplode("hist").alias("bin", "c")).filter("c > 0").select("frame_id", "bin", F.col("c").cast("long").alias("cnt"))


@query(f"WITH {EMB} SELECT frame_id, printf('frame-%06d.jpg', frame_id) AS name, printf('%.6f %.6f %.6f ', v[1], v[2], v[3]) AS line FROM emb")
def text_formats(spark, sf_dir):
    e = proxies.embeddings(spark, sf_dir)
    return e.select("frame_id", names.frame_name(F.col("frame_id")).alias("name"), names.feature_text(vec.head("hist", 3)).alias("line"))


# Distances ----------------------------------------------------------------------------------------


def lagged(metric: str):
    def run(spark, sf_dir):
        e = proxies.embeddings(spark, sf_dir)
        return chunked(e, lambda w: {"d": signal.consecutive(w, "hist", metric)}, 1, 0).select("video_id", "frame_id", r6("d").alias("d"))

    run.__name__ = f"lag_{metric}"
    return run


query(f"WITH {EMB} SELECT video_id, frame_id, round(list_distance(v, lag(v) OVER {W}), 6) AS d FROM emb")(lagged("l2"))
query(f"WITH {EMB} SELECT video_id, frame_id, round(list_sum(list_transform(list_zip(v, p), lambda x: abs(x[1] - x[2]))), 6) AS d FROM (SELECT *, lag(v) OVER {W} AS p FROM emb)")(lagged("l1"))
query(f"WITH {EMB} SELECT video_id, frame_id, round(1 - list_cosine_similarity(v, lag(v) OVER {W}), 6) AS d FROM emb")(lagged("cosine"))


@query(f"WITH {EMB} SELECT a.video_id, a.frame_id, round(corr(a.x, a.y), 6) AS r FROM (SELECT video_id, frame_id, unnest(v) AS x, unnest(n) AS y FROM (SELECT *, lead(v) OVER {W} AS n FROM emb) WHERE n IS NOT NULL) a GROUP BY ALL")
def corr_next(spark, sf_dir):
    e = proxies.embeddings(spark, sf_dir)
    return chunked(e, lambda w: {"r": vec.pearson(F.col("hist"), F.lead("hist").over(w))}, 0, 1).filter("r IS NOT NULL").select("video_id", "frame_id", r6("r").alias("r"))


@query(f"WITH {DOC}, d AS (SELECT video_id, list_distance(h, lag(h) OVER {W}) AS d FROM norm) SELECT video_id, greatest(count(*) FILTER (WHERE d > 0.4), 1) AS k FROM d GROUP BY ALL")
def estimate_k(spark, sf_dir):
    return cluster.estimate_k(proxies.documents(spark, sf_dir).filter("n_pixels > 0"))


# Clustering ---------------------------------------------------------------------------------------


@query(f"WITH {passes(0)} SELECT video_id, frame_id, cluster_id, round(dist, 6) AS dist FROM a0")
def nearest_centroid(spark, sf_dir):
    e = proxies.embeddings(spark, sf_dir)
    return cluster.assign(e, cluster.first_rows(e, K, "hist"), "hist").select("video_id", "frame_id", F.col("cluster_id").cast("long"), r6("dist").alias("dist"))


@query(f"WITH {passes(0)} SELECT video_id, cluster_id, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM c0")
def first_k_seeds(spark, sf_dir):
    s = cluster.first_rows(proxies.embeddings(spark, sf_dir), K, "hist")
    return s.select("video_id", F.col("cluster_id").cast("long"), r6(F.col("vec")[0]).alias("first"), r6(vec.total("vec")).alias("total"))


def passes_of(n: int, name: str):
    def run(spark, sf_dir):
        found, _ = cluster.kmeans(proxies.embeddings(spark, sf_dir), K, "hist", max_passes=n)
        return found.select("video_id", "frame_id", F.col("cluster_id").cast("long"), r6("dist").alias("dist"))

    run.__name__ = name
    query(f"WITH {passes(n)} SELECT video_id, frame_id, cluster_id, round(dist, 6) AS dist FROM a{n}")(run)


passes_of(1, "kmeans_1")
passes_of(3, "kmeans_fixed3")


@query(f"WITH {passes(3)} SELECT count(*) AS changed FROM a0 JOIN a3 USING (video_id, frame_id) WHERE a0.cluster_id <> a3.cluster_id")
def label_changes(spark, sf_dir):
    e = proxies.embeddings(spark, sf_dir)
    return cluster.label_changes(cluster.assign(e, cluster.first_rows(e, K, "hist"), "hist"), cluster.kmeans(e, K, "hist", max_passes=3)[0])


@query(f"WITH {passes(3)} SELECT video_id, cluster_id, frame_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY video_id, cluster_id ORDER BY dist, frame_id) AS rn FROM a3) WHERE rn = 1")
def keyframe_per_cluster(spark, sf_dir):
    found, _ = cluster.kmeans(proxies.embeddings(spark, sf_dir), K, "hist", max_passes=3)
    return cluster.keyframes(found).select("video_id", F.col("cluster_id").cast("long"), "frame_id", r6("dist").alias("dist"))


@query(f"WITH {passes(1)} SELECT video_id, round(sum(dist * dist), 6) AS distortion FROM a1 GROUP BY ALL")
def distortion(spark, sf_dir):
    found, _ = cluster.kmeans(proxies.embeddings(spark, sf_dir), K, "hist", max_passes=1)
    return cluster.distortion(found).select("video_id", r6("distortion").alias("distortion"))


@query(f"WITH {EMB} SELECT pos, round(avg(x), 6) AS mean FROM (SELECT unnest(v) AS x, unnest(range(64)) AS pos FROM emb) GROUP BY ALL")
def column_means(spark, sf_dir):
    m = cluster.column_means(proxies.embeddings(spark, sf_dir), "hist")
    return m.select(F.posexplode("vec").alias("pos", "x")).select(F.col("pos").cast("long").alias("pos"), r6("x").alias("mean"))


@query(f"WITH RECURSIVE {EMB}, o AS (SELECT *, row_number() OVER {W} AS rn FROM emb), g AS (SELECT video_id, 1::BIGINT AS rn, [frame_id] AS ids, [v] AS vs FROM o WHERE rn = 1 UNION ALL SELECT g.video_id, o.rn, CASE WHEN len([x for x in g.vs if list_distance(x, o.v) < {NEAR}]) = 0 THEN list_append(g.ids, o.frame_id) ELSE g.ids END, CASE WHEN len([x for x in g.vs if list_distance(x, o.v) < {NEAR}]) = 0 THEN list_append(g.vs, o.v) ELSE g.vs END FROM g JOIN o ON o.video_id = g.video_id AND o.rn = g.rn + 1) SELECT video_id, unnest(ids) AS frame_id FROM g WHERE (video_id, rn) IN (SELECT (video_id, max(rn)) FROM o GROUP BY video_id)")
def dedup_greedy(spark, sf_dir):
    return cluster.dedup_greedy(proxies.embeddings(spark, sf_dir), "hist", NEAR)


LBG = [EMB, f"l0 AS (SELECT 0 AS cluster_id, [{', '.join(f'avg(v[{j + 1}])' for j in range(64))}] AS v FROM emb)"]
for _k, _size in enumerate((1, 2)):
    LBG.append(f"s{_k} AS (SELECT cluster_id, [x * 1.051::DOUBLE for x in v] AS v FROM l{2 * _k} UNION ALL SELECT cluster_id + {_size}, [x * 0.949::DOUBLE for x in v] FROM l{2 * _k})")
    for _j in (1, 2):
        _from, _to = (f"s{_k}" if _j == 1 else f"t{_k}"), (f"t{_k}" if _j == 1 else f"l{2 * _k + 2}")
        LBG.append(f"n{_k}{_j} AS (SELECT cluster_id, v FROM (SELECT c.cluster_id, e.v, row_number() OVER (PARTITION BY e.frame_id ORDER BY list_distance(e.v, c.v), c.cluster_id) AS rn FROM emb e CROSS JOIN {_from} c) WHERE rn = 1)")
        LBG.append(f"m{_k}{_j} AS (SELECT cluster_id, count(*) AS n, [{', '.join(f'avg(v[{j + 1}])' for j in range(64))}] AS v FROM n{_k}{_j} GROUP BY ALL)")
        LBG.append(f"{_to} AS (SELECT c.cluster_id, coalesce(m.v, c.v) AS v, coalesce(m.n, 0) AS n FROM {_from} c LEFT JOIN m{_k}{_j} m USING (cluster_id))")


@query(f"WITH {', '.join(LBG)} SELECT CAST(cluster_id AS BIGINT) AS word, n AS n_points, round(v[1], 6) AS first FROM l4")
def lbg_split4(spark, sf_dir):
    words, n = cluster.lbg(proxies.embeddings(spark, sf_dir), "hist", 4, passes=2)
    return spark.createDataFrame([(k, int(n[k]), float(w[0])) for k, w in enumerate(words)], "word long, n_points long, first double").withColumn("first", r6("first"))


@query(f"WITH {', '.join(LBG)} SELECT CAST(cluster_id AS BIGINT) AS word, n AS n_points, round(v[2], 6) AS second FROM l4 WHERE cluster_id < 3")
def lbg_truncated3(spark, sf_dir):
    """Four words are made, three are kept."""
    words, n = cluster.lbg(proxies.embeddings(spark, sf_dir), "hist", 3, passes=2)
    return spark.createDataFrame([(k, int(n[k]), float(w[1])) for k, w in enumerate(words)], "word long, n_points long, second double").withColumn("second", r6("second"))


@query(f"WITH {EMB}, book AS (SELECT row_number() OVER (ORDER BY frame_id) - 1 AS word, v FROM emb QUALIFY word < 16), n AS (SELECT e.video_id, b.word, row_number() OVER (PARTITION BY e.frame_id ORDER BY list_distance(e.v, b.v), b.word) AS rn FROM emb e CROSS JOIN book b) SELECT video_id, CAST(word AS INT) AS word, count(*) AS cnt FROM n WHERE rn = 1 GROUP BY ALL")
def word_histogram(spark, sf_dir):
    return words_by(spark, sf_dir, ("video_id",))


def words_by(spark: SparkSession, sf_dir: str, keys: tuple[str, ...]) -> DataFrame:
    e = proxies.embeddings(spark, sf_dir)
    first = e.orderBy("frame_id").limit(16).collect()  # the codebook: 16 fixed rows
    book = spark.createDataFrame([(k, r["hist"]) for k, r in enumerate(first)], "cluster_id int, vec array<double>")
    return bovw.word_histogram(e.withColumnRenamed("hist", "vec"), book, keys=keys)


@query(f"WITH {EMB}, book AS (SELECT row_number() OVER (ORDER BY frame_id) - 1 AS word, v FROM emb QUALIFY word < 16), n AS (SELECT e.video_id, e.frame_id, b.word, row_number() OVER (PARTITION BY e.frame_id ORDER BY list_distance(e.v, b.v), b.word) AS rn FROM emb e CROSS JOIN book b) SELECT video_id, frame_id, CAST(word AS INT) AS word, count(*) AS cnt FROM n WHERE rn = 1 GROUP BY ALL")
def word_histogram_frames(spark, sf_dir):
    return words_by(spark, sf_dir, ("video_id", "frame_id"))


@query()
def xmeans(spark, sf_dir):
    return cluster.xmeans_groups(proxies.embeddings(spark, sf_dir), ("video_id",), "hist")


# Signals ------------------------------------------------------------------------------------------


def evented(name: str, oracle: str, before: int, after: int, compute, of=signals):
    def run(spark, sf_dir):
        return chunked(of(spark, sf_dir), lambda w: {"y": compute(w)}, before, after).select("video_id", "frame_id", v6("y").alias("y"))

    run.__name__ = name
    query(f"WITH {EVT} SELECT video_id, frame_id, round({oracle} + 1e-9::DOUBLE, 6) AS y FROM dis")(run)


evented("dissimilarity", "dissim", 1, 1, lambda w: signal.dissimilarity(w, "hist"))
evented("nbhd_max_filter20", filtered("dissim", 20), 20, 19, lambda w: signal.neighbourhood_max(w, "dissim", 20), with_dissimilarity)
evented("nbhd_max_filter24", filtered("dissim", 24), 24, 23, lambda w: signal.neighbourhood_max(w, "dissim", 24), with_dissimilarity)
evented("conv_edge", f"lead(gray_var, 1, 0) OVER {W} - gray_var", 0, 1, lambda w: signal.convolve(w, "gray_var", (1, -1)))
evented("conv_second", f"lead(gray_var, 1, 0) OVER {W} - 2 * gray_var + lag(gray_var, 1, 0) OVER {W}", 1, 1, lambda w: signal.convolve(w, "gray_var", (1, -2, 1)))
evented("first_difference", f"gray_var - lag(gray_var) OVER {W}", 1, 0, lambda w: signal.difference(w, "gray_var"))
evented("median5", "CASE WHEN count(*) OVER (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) = 5 THEN median(gray_var) OVER (PARTITION BY video_id ORDER BY frame_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) ELSE 0.0 END", 0, 4, lambda w: signal.median5(w, "gray_var"))


@query(f"WITH {EVT} SELECT video_id, frame_id, round(gray_var / max(gray_var) OVER (PARTITION BY video_id), 6) AS ratio, CASE WHEN gray_var / max(gray_var) OVER (PARTITION BY video_id) < 0.1 THEN 0 ELSE 1 END AS effect FROM sig")
def fades(spark, sf_dir):
    s = signal.by_maximum(signals(spark, sf_dir), "gray_var", "ratio")
    return s.select("video_id", "frame_id", r6("ratio").alias("ratio"), signal.fade(F.col("ratio")).alias("effect"))


@query(f"WITH {EVT} SELECT video_id, frame_id, CASE WHEN {filtered('dissim', 20)} > {CUT_HERE} THEN 0 ELSE 1 END AS effect FROM dis")
def cuts(spark, sf_dir):
    s = chunked(with_dissimilarity(spark, sf_dir), lambda w: {"f": signal.neighbourhood_max(w, "dissim", 20)}, 20, 19)
    return s.select("video_id", "frame_id", signal.cut(F.col("f"), CUT_HERE).alias("effect"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.effects(with_dissimilarity(spark, sf_dir), cut_limit=CUT_HERE)


@query(f"WITH RECURSIVE {EVT}, {EFFECTS} SELECT video_id, frame_id, effect FROM eff")
def effects(spark, sf_dir):
    return masked(spark, sf_dir).select("video_id", "frame_id", "effect")


@query(f"WITH RECURSIVE {EVT}, {EFFECTS}, {SHOTS} SELECT video_id, CAST(shot_id AS INT) AS shot_id, start_frame, end_frame FROM shots")
def shots(spark, sf_dir):
    return signal.shots(masked(spark, sf_dir))


@query(f"WITH RECURSIVE {EVT}, {EFFECTS}, {SHOTS} SELECT s.video_id, CAST(shot_id AS INT) AS shot_id, frame_id, round(gray_var + 1e-9::DOUBLE, 6) AS gray_var FROM sig s JOIN shots t ON s.video_id = t.video_id AND s.frame_id BETWEEN t.start_frame AND t.end_frame")
def shot_frames(spark, sf_dir):
    s = with_dissimilarity(spark, sf_dir)
    found = signal.shots(signal.effects(s, cut_limit=CUT_HERE))
    return signal.shot_frames(s, found).select("video_id", "shot_id", "frame_id", v6("gray_var").alias("gray_var"))


@query(f"WITH {EVT} SELECT video_id, count(*) FILTER (WHERE y > 0) AS nscenes FROM (SELECT video_id, {filtered('dissim', 24)} AS y FROM dis) GROUP BY ALL")
def scene_count(spark, sf_dir):
    return signal.scene_count(with_dissimilarity(spark, sf_dir))


@query(f"WITH RECURSIVE {EVT}, {EFFECTS}, {SHOTS}, {merged_of('shots', 'joined')} SELECT video_id, start_frame, end_frame FROM joined")
def interval_merge(spark, sf_dir):
    return signal.merge_intervals(signal.shots(masked(spark, sf_dir)))


@query(f"WITH RECURSIVE {EVT}, ra AS (SELECT video_id, frame_id, gray_var / max(gray_var) OVER (PARTITION BY video_id) AS y FROM sig), {spline_of('ra')} SELECT video_id, frame_id, round(v, 6) AS smooth FROM sm")
def smooth_spline(spark, sf_dir):
    s = signal.by_maximum(signals(spark, sf_dir), "gray_var", "ratio")
    return signal.smooth(s, "ratio").select("video_id", "frame_id", r6("smooth").alias("smooth"))


@query(f"WITH RECURSIVE {EVT}, sv AS (SELECT video_id, frame_id, gray_var AS var FROM sig), {dissolved_of('sv')} SELECT video_id, start_frame, end_frame FROM dissolved")
def dissolves(spark, sf_dir):
    return signal.dissolves(signals(spark, sf_dir))


# Summaries ----------------------------------------------------------------------------------------


@query(f"WITH {DOC}, n AS (SELECT *, lead(h) OVER {W} AS h2, lead(raw) OVER {W} AS r2 FROM norm), c AS (SELECT video_id, frame_id, any_value(list_sum(list_transform(list_zip(h, h2), lambda x: abs(x[1] - x[2])))) AS d, corr(x, y) AS r FROM (SELECT *, unnest(raw) AS x, unnest(r2) AS y FROM n WHERE h2 IS NOT NULL) GROUP BY ALL) SELECT video_id, frame_id FROM norm EXCEPT ALL SELECT video_id, frame_id FROM c WHERE d < 0.5 AND r > 0.95")
def pair_filter(spark, sf_dir):
    d = proxies.documents(spark, sf_dir).filter("n_pixels > 0")
    return summary.pair_filter(d, "hist_norm", "hist", None, correlation=0.95).select("video_id", "frame_id")


@query(f"WITH {EMB}, p AS (SELECT *, lead(v) OVER {W} AS n FROM emb), t AS (SELECT video_id, frame_id, unnest(range(1, 65)) AS i, unnest(v) AS x, unnest(n) AS y FROM p WHERE n IS NOT NULL), c AS (SELECT video_id, frame_id, sum(abs(x - y)) FILTER (WHERE i <= 16) AS d, corr(x, y) FILTER (WHERE i BETWEEN 17 AND 40) AS a, corr(x, y) FILTER (WHERE i > 40) AS b FROM t GROUP BY ALL) SELECT video_id, frame_id FROM emb EXCEPT ALL SELECT video_id, frame_id FROM c WHERE d < 2.5 AND a > 0.02 AND b > 0.02")
def pair_filter_pixels(spark, sf_dir):
    """Parts of each vector as hues, colours and pixels."""
    e = proxies.embeddings(spark, sf_dir).select("video_id", "frame_id", F.slice("hist", 1, 16).alias("hue_norm"), F.slice("hist", 17, 24).alias("rgb"), F.slice("hist", 41, 24).alias("pixels"))
    return summary.pair_filter(e, hue_limit=2.5, correlation=0.02).select("video_id", "frame_id")


@query("WITH ev AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS frame_id, CAST(least(255, floor(value)) AS INT) AS gray FROM events) SELECT frame_id, round(var_pop(gray) + 1e-9::DOUBLE, 6) AS gray_var FROM ev GROUP BY ALL HAVING var_pop(gray) > 700")
def low_variance_filter(spark, sf_dir):
    s = histogram.gray_statistics(proxies.event_pixels(spark, sf_dir), F.col("gray"))
    return summary.low_variance_filter(s).select("frame_id", v6("gray_var").alias("gray_var"))


def frame_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("video_id"), F.col("doc_id").alias("frame_id"), "n_chars")


def key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 0").join(frame_rows(spark, sf_dir), F.col("doc_id") == F.col("frame_id")).select("video_id", "frame_id")


@query("SELECT source AS video_id, doc_id AS frame_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def summary_semi(spark, sf_dir):
    return summary.summary_frames(frame_rows(spark, sf_dir), key_rows(spark, sf_dir))


@query("SELECT doc_id AS video_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def summary_anti(spark, sf_dir):
    videos = frame_rows(spark, sf_dir).select(F.col("frame_id").alias("video_id"), "n_chars")
    return summary.unfinished(videos, spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("video_id")))


# Whole methods ------------------------------------------------------------------------------------


def summary_oracle(preset: str) -> str:
    """The whole method in lists: a row a video and pass of k-means, then the keyframes in order, each kept unless one before it is near."""
    p = pipelines.PRESETS[preset]
    dist = {"l2": "list_distance({}, {})", "l1": "list_sum(list_transform(list_zip({}, {}), lambda z: abs(z[1] - z[2])))"}[p.metric].format
    even = {"std": "list_stddev_pop(h) <", "fixed_mean": "sqrt(list_sum([(x - 0.0625) * (x - 0.0625) for x in h]) / 16) <=", "root_squares": "sqrt(list_sum([x * x for x in h])) <="}[p.spread]
    jumps = ", ".join(f"nullif(count(*) FILTER (WHERE d > {t}), 0)" for t in p.k_thresholds)
    members = "len(list_filter(label, lambda l: l = j))"
    moved = f"[CASE WHEN {members} > {0 if p.single else 1} THEN [list_sum([CASE WHEN label[i] = j THEN pts[i][m] ELSE 0 END for i in range(1, len(pts) + 1)]) / {members} for m in range(1, 17)] ELSE c[j] END for j in range(1, len(c) + 1){f' if {members} > 0' if p.empty == 'drop' else ''}]"
    near = "list_transform(pts, lambda p: list_position([{0} for q in c], list_min([{0} for q in c])))".format(dist("p", "q"))
    alone = f"len([x for x in g.vs if {dist('x', 'o.h')} < {p.dedup}]) = 0"
    return f"""WITH RECURSIVE {DOC}, kept AS (SELECT video_id, frame_id, h, raw FROM norm WHERE {even} {p.max_std}),
kk AS (SELECT video_id, coalesce({jumps}, 1) AS k FROM (SELECT video_id, {dist("h", f"lag(h) OVER {W}")} AS d FROM kept) GROUP BY ALL),
vid AS (SELECT video_id, any_value(k) AS k, list(raw ORDER BY frame_id) AS pts, list(h ORDER BY frame_id) AS hs, list(frame_id ORDER BY frame_id) AS ids FROM kept JOIN kk USING (video_id) GROUP BY video_id),
km AS (SELECT video_id, 0 AS pass, pts[1:k] AS c, []::BIGINT[] AS seen, false AS done FROM vid
  UNION ALL SELECT video_id, pass + 1, moved, CASE WHEN len(moved) < len(c) THEN [] ELSE label END, label = seen AND len(moved) = len(c) FROM (SELECT *, {moved} AS moved FROM (SELECT km.*, pts, {near} AS label FROM km JOIN vid USING (video_id) WHERE NOT done AND pass < 501))),
fit AS (SELECT video_id, pts, hs, ids, c, {near} AS label FROM (SELECT video_id, arg_max(c, pass) AS c FROM km GROUP BY video_id) JOIN vid USING (video_id)),
fr AS (SELECT video_id, ids[i] AS frame_id, hs[i] AS h, label[i] AS cluster, {dist("pts[i]", "c[label[i]]")} AS d FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM fit)),
o AS (SELECT video_id, frame_id, h, row_number() OVER {W} AS rn FROM (SELECT *, row_number() OVER (PARTITION BY video_id, cluster ORDER BY d, frame_id) AS best FROM fr) WHERE best = 1),
g AS (SELECT video_id, 1::BIGINT AS rn, [frame_id] AS ids, [h] AS vs FROM o WHERE rn = 1 UNION ALL SELECT g.video_id, o.rn, CASE WHEN {alone} THEN list_append(g.ids, o.frame_id) ELSE g.ids END, CASE WHEN {alone} THEN list_append(g.vs, o.h) ELSE g.vs END FROM g JOIN o ON o.video_id = g.video_id AND o.rn = g.rn + 1)
SELECT video_id, unnest(ids) AS frame_id FROM g WHERE (video_id, rn) IN (SELECT (video_id, max(rn)) FROM o GROUP BY video_id)"""


def summary_of(preset: str):
    def run(spark, sf_dir):
        return pipelines.histogram_summary(proxies.documents(spark, sf_dir).filter("n_pixels > 0"), preset)

    run.__name__ = f"histogram_summary_{preset}"
    query(summary_oracle(preset))(run)


for _preset in pipelines.PRESETS:
    summary_of(_preset)


def event_descriptors(s: DataFrame) -> DataFrame:
    """Each event type's 16 bins as a descriptor of its hour."""
    pieces = F.array(*(F.slice("hist", 16 * k + 1, 16) for k in range(len(EVENT_TYPES))))
    return s.select("video_id", "frame_id", F.posexplode(pieces).alias("desc_id", "vec"))


@query()
def shot_summary(spark, sf_dir):
    s = signals(spark, sf_dir)
    return pipelines.shot_summary(s, event_descriptors(s), pipelines.ShotParameters(cut_limit=CUT_HERE))


def text_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as square images: all bytes of their HTML as three channels, the rest of the last rows black."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.lit("pages").alias("video_id"), F.col("page_id").alias("frame_id"), F.encode("html", "UTF-8").alias("raw"))
    side = F.ceil(F.sqrt(F.ceil(F.octet_length("raw") / 3))).cast("int")
    return p.withColumn("height", side).withColumn("width", side).withColumn("data", F.expr("rpad(raw, height * width * 3, X'00')")).drop("raw")


def hex_byte(at: int) -> str:
    return f"((instr('0123456789ABCDEF', px[{at}]) - 1) * 16 + instr('0123456789ABCDEF', px[{at + 1}]) - 1)"


IMAGES = f"""im AS (SELECT page_id AS frame_id, hex(encode(html)) AS raw, CAST(ceil(sqrt(ceil(strlen(html) / 3))) AS BIGINT) AS side FROM pages),
pl AS (SELECT frame_id, side, unnest(regexp_extract_all(rpad(raw, CAST(side * side * 6 AS INT), '0'), '......')) AS px, unnest(range(side * side)) AS i FROM im WHERE side > 0),
bgr AS (SELECT frame_id, side, i // side AS y, i % side AS x, {hex_byte(1)} AS b, {hex_byte(3)} AS g, {hex_byte(5)} AS r FROM pl),
gy AS (SELECT *, round(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE) AS gray, greatest(r, g, b) // 16 AS bin FROM bgr)"""


@query(f"""WITH {IMAGES}, st AS (SELECT frame_id, count(*) AS n_pixels, round(var_pop(gray) + 1e-9::DOUBLE, 6) AS gray_var FROM gy GROUP BY ALL), c AS (SELECT frame_id, bin, count(*) AS cnt FROM gy GROUP BY ALL)
SELECT st.*, CAST(b.bin AS INT) AS bin, coalesce(c.cnt, 0) AS cnt FROM st CROSS JOIN (SELECT unnest(range(16)) AS bin) b LEFT JOIN c ON c.frame_id = st.frame_id AND c.bin = b.bin""")
def image_features(spark, sf_dir):
    f = histogram.image_features(text_images(spark, sf_dir), "hsv")
    long = f.select("frame_id", "n_pixels", v6("gray_var").alias("gray_var"), F.posexplode(histogram.value_channel(F.col("hist"))).alias("bin", "cnt"))
    return long.withColumn("cnt", F.col("cnt").cast("long"))


HOG = f"""gr AS (SELECT frame_id, side // 8 AS n, y, x, coalesce(sqrt(lead(gray) OVER h) - sqrt(lag(gray) OVER h), 0) AS dx, coalesce(sqrt(lead(gray) OVER v) - sqrt(lag(gray) OVER v), 0) AS dy FROM gy WINDOW h AS (PARTITION BY frame_id, y ORDER BY x), v AS (PARTITION BY frame_id, x ORDER BY y)),
tu AS (SELECT frame_id, n, y // 8 AS cy, x // 8 AS cx, sqrt(dx * dx + dy * dy) AS size, atan2(dy, dx) - pi() * floor(atan2(dy, dx) / pi()) AS a FROM gr WHERE n > 1 AND y < n * 8 AND x < n * 8),
vo AS (SELECT *, CAST(floor(a / (pi() / 9) - 0.5) AS INT) AS low, a / (pi() / 9) - 0.5 - floor(a / (pi() / 9) - 0.5) AS part FROM tu),
ce AS (SELECT frame_id, n, cy, cx, o, sum(s) AS v FROM (SELECT frame_id, n, cy, cx, (low + 9) % 9 AS o, size * (1 - part) AS s FROM vo UNION ALL SELECT frame_id, n, cy, cx, (low + 1) % 9, size * part FROM vo) GROUP BY ALL),
ad AS (SELECT frame_id, n, cy, cx, o, coalesce(v, 0) AS v FROM (SELECT DISTINCT frame_id, n, cy, cx FROM ce) CROSS JOIN (SELECT unnest(range(9)) AS o) LEFT JOIN ce USING (frame_id, n, cy, cx, o)),
wi AS (SELECT frame_id, (cy - q % 2) * (n - 1) + cx - q // 2 AS win, q, o, v FROM ad CROSS JOIN (SELECT unnest(range(4)) AS q) WHERE cy - q % 2 BETWEEN 0 AND n - 2 AND cx - q // 2 BETWEEN 0 AND n - 2),
cl AS (SELECT frame_id, win, q, o, least(v / (sqrt(sum(v * v) OVER (PARTITION BY frame_id, win)) + 3.6), 0.2) AS v FROM wi)"""


@query(f"WITH {IMAGES}, {HOG} SELECT frame_id, CAST(win * 4 + q AS INT) AS desc_id, CAST(o AS INT) AS pos, round(v / (sqrt(sum(v * v) OVER (PARTITION BY frame_id, win)) + 0.001), 6) AS x FROM cl")
def hog(spark, sf_dir):
    d = bovw.descriptors(text_images(spark, sf_dir), "hog")
    return d.select("frame_id", "desc_id", F.posexplode("vec").alias("pos", "x")).withColumn("x", r6("x"))
