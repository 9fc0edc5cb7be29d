"""Near copies by shingle similarity: texts whose sets of ``width``-word shingles have a Jaccard of ``similarity`` or more.

Words are those of ``simhash``. Candidates come from its Gray-order index, which finds all pairs of sets whose
fingerprints differ in ``radius`` bits or fewer, and from MinHash bands, as many pairs at 0.8 differ in more. Each
link is checked on the whole sets:

1. Texts of equal sets are one class, with a SimHash fingerprint of the set. The index joins distinct fingerprints, and
   the components of its links are buckets: any pair that it finds is in one.
2. A set also has ``BANDS`` keys of ``ROWS`` minima each, a bucket for each key: two sets of Jaccard ``s`` share none with
   a probability of ``(1 - s ** ROWS) ** BANDS``, which is 0.00007 at 0.8 and less above it.
3. Buckets of the same members are one. Each goes to one task with a text of each member; one of more than ``hot`` members
   is dealt to chunks, anew for each band.
4. In a bucket, sets are compared with all that are not yet connected to them, those that share most with the bucket
   first, so that a family of near copies takes few comparisons. A bucket returns a forest.
5. Buckets in chunks whose members are not all connected after that meet again, each chunk with each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.llm import simhash, slices
from framelode.scratch import written

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
HOT = 1 << 8
PART = 1 << 11  # shingles whose minima are taken at once
ADD, TIMES = np.random.default_rng(17).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
TIMES |= np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles. Fewer than ``width`` words make one shingle; no words none."""
    return np.unique(np.array(simhash.shingle_hashes(text, width), np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A signed key for each band; an empty set has none."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(found), PART):
        x = (found[None, k : k + PART] ^ ADD) * TIMES
        least = np.minimum(least, x.min(axis=1))
    data, n = least.tobytes(), 8 * ROWS
    return np.array([xxhash.xxh64_intdigest(data[k : k + n], 42) for k in range(0, len(data), n)], np.uint64).view(np.int64).tolist()


def sketches(keyed: DataFrame, width: int = WIDTH) -> DataFrame:
    """``key, set long, fp long, bands array<long>`` for rows ``key, text``: the hash of the set of shingles, its fingerprint
    and its keys."""
    narrow = keyed.select("key", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingles(t, width) for t in b.column(1).to_pylist()]
            names = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            prints = np.array([simhash.print_of(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(prints), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["key", "set", "fp", "bands"])

    return narrow.mapInArrow(scan, f"key {narrow.schema[0].dataType.simpleString()}, set long, fp long, bands array<long>")


def indexed(classes: DataFrame, radius: int) -> DataFrame:
    """``set, t, k``: the bucket of each set in the Gray-order index over ``classes (set, fp)``: the least fingerprint that its own
    reaches over links of ``radius`` bits."""
    prints = written(classes.groupBy("fp").agg(F.count("*").alias("n")), "prints")
    roots = simhash.components(simhash.forest(prints.select("fp"), radius))
    rooted = written(prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("k"), "n"), "rooted")
    return written(simhash.meet(classes.select("set", "fp"), rooted, ["fp"]).select("set", F.lit(BANDS).alias("t"), "k"), "indexed")


def connected(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the least one that it reaches over links of ``similarity`` or more. Sets are not empty."""
    label, size = np.arange(len(sets)), np.array([len(s) for s in sets])
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    owner, limit = np.repeat(label, size), round(similarity * 1000)
    shared = np.bincount(owner, np.bincount(code)[code]) / size
    first = np.r_[0, np.cumsum(size)]
    for i in np.argsort(-shared, kind="stable"):
        if not label.any():
            break
        mark = np.zeros(len(values), bool)
        mark[code[first[i] : first[i + 1]]] = True
        common = np.add.reduceat(mark[code], first[:-1], dtype=np.int64)
        near = np.flatnonzero((common * 1000 >= limit * (size + size[i] - common)) & (label != label[i]))
        label = simhash.shrink(label, np.full(len(near), i), near)
    return label


def linked(members: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges ``a, b`` that connect what links connect in each bucket ``t, k, c`` of ``members (t, k, c, set)``; ``texts``: ``set, text``."""
    dealt = members.join(texts, "set").select("t", "k", "c", "set", "text").repartition("t", "k", "c").sortWithinPartitions("t", "k", "c")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(names: list[int], texts: list[str]) -> pa.RecordBatch:
            label = connected([shingles(t, width) for t in texts], similarity)
            a = np.flatnonzero(label != np.arange(len(label)))
            names = np.array(names, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[label[a]])], ["a", "b"])

        now, names, texts = None, [], []
        for b in slices(batches):  # rows of a bucket come one after another
            for *bucket, name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    if len(names) > 1:
                        yield edges(names, texts)
                    now, names, texts = bucket, [], []
                names.append(name)
                texts.append(text)
        if len(names) > 1:
            yield edges(names, texts)

    return dealt.mapInArrow(join, "a long, b long")


def near_copies(keyed: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, hot: int = HOT, radius: int = simhash.RADIUS) -> DataFrame:
    """``key, component`` for the least key of each set of rows ``key, text``: component is the least set that it reaches.

    Texts without words, and null ones, are one set, which links to no other."""
    sketched = written(sketches(keyed, width), "sketches")
    classes = written(sketched.groupBy("set").agg(F.min("key").alias("key"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("set", F.posexplode("bands").alias("t", "k")).unionByName(indexed(classes.filter(F.size("bands") > 0), radius))
    mark = F.xxhash64("set")
    buckets = banded.groupBy("t", "k").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("y")).filter("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("t", "k")).alias("at")).select("at.t", "at.k", "n", F.ceil(F.col("n") / hot).cast("int").alias("chunks"))
    members = written(simhash.meet(banded, written(buckets, "buckets"), ["t", "k"]).drop("n"), "members")
    wanted = members.select("set").distinct().join(classes.select("set", "key"), "set")
    texts = written(keyed.join(wanted, "key").select("set", "text").dropDuplicates(["set"]), "texts")
    chunk = F.pmod(F.xxhash64("set", "t"), F.col("chunks")).cast("long")
    edges = written(linked(members.withColumn("c", chunk), texts, width, similarity), "edges")
    roots = simhash.components(edges)
    wide = members.filter("chunks > 1")
    if not wide.isEmpty():
        roots = written(roots, "roots")
        named = wide.join(roots, wide["set"] == roots["fp"], "left").select("t", "k", F.coalesce("root", "set").alias("root"))
        open_ = named.groupBy("t", "k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("t", "k", "n")
        others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.least(j, chunk) * F.col("chunks") + F.greatest(j, chunk))
        met = simhash.meet(wide, written(open_, "open-buckets"), ["t", "k"]).drop("n").withColumn("c", F.explode(others))
        roots = simhash.components(edges.union(linked(met, texts, width, similarity)))
    return classes.join(roots, classes["set"] == roots["fp"], "left").select("key", F.coalesce("root", "set").alias("component"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """``df`` with one row of each component of near copies, as ``simhash.one_of_each`` takes it."""
    return simhash.least_rows(df, id_col, text_col, lambda keyed: near_copies(keyed, **options))
