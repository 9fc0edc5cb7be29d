"""Vector functions over ARRAY<DOUBLE> columns, all inside the JVM.

Nulls give null. Vectors of different lengths: the missing places are null, and so is the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(a: Column | str) -> Column:
    return F.aggregate(col(a), F.lit(ZERO), lambda s, x: s + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column | str, b: Column | str) -> Column:
    """Euclidean distance."""
    return F.sqrt(squared_l2(a, b))


def l1(a: Column | str, b: Column | str) -> Column:
    """Manhattan distance, also the sum of absolute differences."""
    return total(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)))


DISTANCES = {"l1": l1, "l2": l2}


def pair_sums(a: Column | str, b: Column | str) -> Column:
    """``struct(n, ma, mb, aa, bb, ab)``: size, means and centred sums of products, in one pass that reads each vector once."""
    start = F.struct(*(F.lit(ZERO).alias(c) for c in ("n", "ma", "mb", "aa", "bb", "ab")))

    def step(s: Column, p: Column) -> Column:
        n = s["n"] + 1
        da, db = p["x"] - s["ma"], p["y"] - s["mb"]
        keep = s["n"] / n
        return F.struct(n.alias("n"), (s["ma"] + da / n).alias("ma"), (s["mb"] + db / n).alias("mb"), (s["aa"] + da * da * keep).alias("aa"), (s["bb"] + db * db * keep).alias("bb"), (s["ab"] + da * db * keep).alias("ab"))

    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), start, step)


def cosine_dissimilarity(a: Column | str, b: Column | str) -> Column:
    """1 - a.b / (|a| |b|); null where a vector is zero. One pass that reads each vector once."""
    start = F.struct(*(F.lit(ZERO).alias(c) for c in ("aa", "bb", "ab")))
    pairs = F.zip_with(col(a), col(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.aggregate(
        pairs,
        start,
        lambda s, p: F.struct((s["aa"] + p["x"] * p["x"]).alias("aa"), (s["bb"] + p["y"] * p["y"]).alias("bb"), (s["ab"] + p["x"] * p["y"]).alias("ab")),
        lambda s: F.when((s["aa"] > 0) & (s["bb"] > 0), 1 - s["ab"] / (F.sqrt(s["aa"]) * F.sqrt(s["bb"]))),
    )


def mean(a: Column | str) -> Column:
    return total(a) / F.size(col(a))


def variance(a: Column | str, sample: bool = False) -> Column:
    """Population variance of a vector's entries, or the sample variance (null under two entries)."""
    start = F.struct(*(F.lit(ZERO).alias(c) for c in ("n", "m", "q")))

    def step(s: Column, x: Column) -> Column:
        n, d = s["n"] + 1, x - s["m"]
        return F.struct(n.alias("n"), (s["m"] + d / n).alias("m"), (s["q"] + d * d * s["n"] / n).alias("q"))

    least = 1 if sample else 0
    return F.aggregate(col(a), start, step, lambda s: F.when(s["n"] > least, s["q"] / (s["n"] - least)))


def std(a: Column | str) -> Column:
    return F.sqrt(variance(a))


def squared_deviation(a: Column | str, center: float) -> Column:
    """Squares of the differences from a fixed mean, entry by entry."""
    return F.transform(col(a), lambda x: (x - F.lit(center)) * (x - F.lit(center)))


def pearson(a: Column | str, b: Column | str) -> Column:
    """Correlation of two vectors' entries; null where one is constant."""
    s = F.transform(F.array(pair_sums(a, b)), lambda s: F.when((s["aa"] > 0) & (s["bb"] > 0), s["ab"] / (F.sqrt(s["aa"]) * F.sqrt(s["bb"]))))
    return F.element_at(s, 1)


def normalise(a: Column | str, by: Column | str) -> Column:
    """Entries over a number, such as the pixel count; null over zero."""
    by = col(by)
    return F.when(by != 0, F.transform(col(a), lambda x: x / by))


def head(a: Column | str, n: int) -> Column:
    return F.slice(col(a), 1, n)


def difference(a: Column | str) -> Column:
    """Entry i + 1 less entry i; one entry shorter."""
    a = col(a)
    return F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), lambda x, y: y - x)


def scale(a: Column | str, factor: float) -> Column:
    return F.transform(col(a), lambda x: x * F.lit(factor))


def distances(point: Column | str, others: Column | str, metric: str = "l2") -> Column:
    """Distances from a point to each vector of an ARRAY<ARRAY<DOUBLE>>. Metrics: l1, l2, squared_l2."""
    f = DISTANCES.get(metric, squared_l2)
    return F.transform(col(others), lambda o: f(col(point), o))


def nearest(point: Column | str, centroids: Column | str, metric: str = "l2") -> Column:
    """``struct(dist, cluster_id)`` of the nearest of ``array<struct<cluster_id, vec>>``; ties go to the least id."""
    f = DISTANCES[metric]
    return F.array_min(F.transform(col(centroids), lambda c: F.struct(f(col(point), c["vec"]).alias("dist"), c["cluster_id"].alias("cluster_id"))))


def mean_vector(vec: Column | str, size: int) -> Column:
    """Aggregate: the mean of vectors of a known size, one partial sum for each entry."""
    return F.array(*(F.avg(col(vec)[k]) for k in range(size)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
