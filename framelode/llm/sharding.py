"""Reproducible shuffle into shards: a Feistel permutation over global row numbers.

Rows get gapless numbers in an order that the data fix (not the partitions). A balanced
Feistel network over ``side * side`` cells, ``side = ceil(sqrt(n))``, permutes the numbers;
numbers that leave ``0..n-1`` walk their cycle until they are back. Shard and slot follow:
``permuted % shards`` and ``permuted div shards``, so shard counts are at most one apart.

DataFrame functions only. Scale: only narrow columns are shuffled, once, by a hash of the row's
digest; equal rows are counted before the shuffle, so that no group of copies meets in a task, and dealt
in pieces after it. Texts are read once: the counted groups are a written table. The offsets are one row a hash bucket, of about
``IN_BUCKET`` groups each and ``MOST_BUCKETS`` at most.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.scratch import written

ROUNDS = 6
WALK = 64  # walks of 2 * sqrt(n) + 1 cells at most; the odds of a longer one are (2 / sqrt(n)) ** 64, and it raises
SPREAD, IN_BUCKET, MOST_BUCKETS = 1 << 12, 1 << 16, 1 << 20


def feistel(x: Column, side: int, seed: int) -> Column:
    """One pass of the network over ``0 .. side * side - 1``."""
    start = F.struct((x % side).cast("long").alias("a"), F.floor(x / side).cast("long").alias("b"))
    rounds = F.array(*(F.lit(seed * 1000 + k).cast("long") for k in range(ROUNDS)))
    return F.aggregate(
        rounds,
        start,
        lambda s, k: F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(F.xxhash64(s["b"], k), F.lit(side).cast("long")), F.lit(side).cast("long")).alias("b")),
        lambda s: s["b"] * F.lit(side).cast("long") + s["a"],
    )


def permuted(x: Column, n: int, seed: int = 0) -> Column:
    """The place of row number ``x`` among ``n`` rows: a bijection of ``0 .. n - 1``."""
    if n <= 1:
        return x.cast("long")
    side = isqrt(n - 1) + 1
    total = F.lit(n).cast("long")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel(x.cast("long"), side, seed), lambda at, _: F.when(at < total, at).otherwise(feistel(at, side, seed)))
    return F.when(walked < total, walked).otherwise(F.raise_error(F.lit("a Feistel walk did not return")).cast("long"))


def each_copy(rows: DataFrame, count: str, keys: list[str], number: str, most: int, spread: int = SPREAD) -> DataFrame:
    """A row for each of the ``count`` copies (``most`` at most) that a row stands for, with its ``number`` from 0. Rows of
    more than ``spread`` copies are dealt in pieces first, by ``keys``, so that no task makes all copies of one row."""

    def exploded(df: DataFrame, start: Column) -> DataFrame:
        return df.withColumn(number, F.explode(F.sequence(start, F.least(start + spread, F.col(count)) - 1)))

    zero = F.lit(0).cast("long")
    if most <= spread:
        return exploded(rows.filter(F.col(count) > 0), zero)
    pieces = rows.filter(F.col(count) > spread).withColumn("__start", F.explode(F.sequence(zero, F.col(count) - 1, F.lit(spread).cast("long"))))
    return exploded(rows.filter(F.col(count).between(1, spread)), zero).unionByName(exploded(pieces.repartition(*keys, "__start"), F.col("__start")).drop("__start"))


def numbered(rows: DataFrame, keys: list[str], count: str, groups: int, buckets: int | None = None) -> tuple[DataFrame, int]:
    """``rows``, ``groups`` of them, with the first global row number of each group in ``first``, and the number of rows.

    ``rows`` has a group's size in ``count``; groups are in the order of a hash bucket, then ``keys``. There are ``buckets``
    of them: by default ``SPREAD``, and more where a bucket would have over ``IN_BUCKET`` groups, up to ``MOST_BUCKETS``
    (their offsets pass through the driver)."""
    buckets = buckets or min(MOST_BUCKETS, max(SPREAD, -(-groups // IN_BUCKET)))
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    sizes = bucketed.groupBy("bucket").agg(F.sum(count).alias("in_bucket"))
    offsets, total = [], 0
    for bucket, n in sorted((r["bucket"], r["in_bucket"]) for r in sizes.toLocalIterator()):  # `buckets` rows at most
        offsets.append((bucket, total))
        total += n
    table = rows.sparkSession.createDataFrame(offsets, "bucket long, bucket_first long")
    w = Window.partitionBy("bucket").orderBy(*keys)
    within = F.coalesce(F.sum(count).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = bucketed.withColumn("within", within).join(F.broadcast(table), "bucket")
    return out.withColumn("first", F.col("bucket_first") + F.col("within")).drop("within", "bucket_first", "bucket"), total


def places(rows: DataFrame, keys: list[str], n_shards: int, seed: int, buckets: int | None) -> tuple[DataFrame, int]:
    """``rows`` (``keys``, and ``n`` equal rows of each) with ``copy, shard, slot`` for each of the equal rows, and the most of them."""
    groups, most = rows.agg(F.count("*"), F.max("n")).first()
    placed, total = numbered(rows, keys, "n", groups, buckets)
    at = each_copy(placed, "n", keys, "copy", most or 0).withColumn("at", permuted(F.col("first") + F.col("copy"), total, seed))
    return at.withColumns({"shard": (F.col("at") % n_shards).cast("int"), "slot": F.expr(f"at div {n_shards}")}).drop("at", "first"), most or 0


def size_of(text: Column) -> Column:
    return F.octet_length(text).cast("long") + 16


def shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 40, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """``id_col, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``df``.

    size: UTF-8 bytes of the text plus 16 (null text: 16, checksum of no bytes: 0). Ids may be null
    or repeated: rows that agree in id, size and checksum are alike here and get places of their
    own. An empty table gives an empty table. Other columns are not read. law is ``rows``, so
    ``grown_shard`` is null.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    narrow = df.select(df[id_col].alias("id"), size_of(text).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    groups = written(narrow.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n")), "shard-groups")
    at, _ = places(groups, ["id", "size", "text_crc32"], n_shards, seed, buckets)
    return at.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharded_rows(df: DataFrame, text_col: str = "text", n_shards: int = 40, seed: int = 0, buckets: int | None = None) -> DataFrame:
    """``df`` with ``size, shard, slot`` of each row. Columns of ``df`` with these names come back as ``doc_size`` and so on.

    Rows that agree in every column are alike and get places of their own. They are counted before whole rows are shuffled,
    once, by the hash of the row; a row of over ``SPREAD`` copies is dealt in pieces."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    wide = df.select(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).alias("ident"), row.alias("row"), size_of(F.coalesce(df[text_col], F.lit(""))).alias("size"))
    groups = written(wide.groupBy("ident").agg(F.count("*").alias("n")), "shard-groups")
    at, most = places(groups, ["ident"], n_shards, seed, buckets)
    unique = wide.dropDuplicates(["ident"])
    if most <= SPREAD:
        found = unique.join(at.select("ident", "shard", "slot"), "ident")
    else:
        piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SPREAD).cast("long")))
        found = unique.join(groups.withColumn("piece", piece).drop("n"), "ident").join(at.select("ident", (F.col("copy") - F.col("copy") % SPREAD).alias("piece"), "shard", "slot"), ["ident", "piece"])
    taken = {"size", "shard", "slot"}
    return found.select(*(F.col("row")[c].alias(f"doc_{c}" if c in taken else c) for c in df.columns), "size", "shard", "slot")
