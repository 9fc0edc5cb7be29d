"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target in words; a document's copies are its source's target over the source's
size: a whole part that all its documents get and a fraction. Fractions are rounded in pairs:
mass, counted in words, moves from one document to the other in a random direction, with the odds
that keep each one's expectation, until one of them is whole. The words that a source takes are
thus kept through every pair, and end within one document of the target.

Reduction tree: a source's documents are dealt to leaves by a hash of the row; copies of a row are numbered first, so that they
go to different leaves. A leaf rounds all of
its documents but one at most; the leaves' rests meet in nodes of ``FAN`` rests, level by level, until
each source has one, which is rounded by its own odds. All chances are hashes, so reruns agree.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelode.llm.sharding import each_copy
from framelode.llm.simhash import meet
from framelode.scratch import written

WEIGHTS = (5, 2, 1)
SHARE, LIMIT = 1.5, 2.0
LEAF, FAN = 4096, 64
WORD = r"[^ \x09-\x0D]+"
TINY = 1e-9
ORDER = [("key", "ascending"), ("size", "ascending")]


def chance(*parts: int) -> float:
    """A number in [0, 1) that depends on the parts alone."""
    return xxhash.xxh64_intdigest(struct.pack(f"<{len(parts)}q", *parts), 7) / 2**64


def pivot(size: np.ndarray, p: np.ndarray, salt: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """Round fractions ``p`` of things of ``size`` words, in the order given.

    Returns 0 or 1 for each and the place of the one that is left (-1: none; its fraction stays in ``p``).
    Things without words need no partner: they are rounded by their own odds."""
    done = np.zeros(len(p), np.int64)
    held = -1
    for i in range(len(p)):
        if p[i] <= TINY or p[i] >= 1 - TINY:
            done[i] = round(p[i])
            continue
        if not size[i]:
            done[i] = chance(*salt, i, 1) < p[i]
            continue
        if held < 0:
            held = i
            continue
        a, b = held, i
        up = min((1 - p[a]) * size[a], p[b] * size[b])  # words that a may gain
        down = min(p[a] * size[a], (1 - p[b]) * size[b])  # and lose
        move = up if chance(*salt, i, 0) < down / (up + down) else -down
        p[a] += move / size[a]
        p[b] -= move / size[b]
        left = []
        for k in (a, b):
            if p[k] <= TINY or p[k] >= 1 - TINY:
                done[k] = p[k] > 0.5
            else:
                left.append(k)
        held = left[0] if left else -1
    return done, held


def ranked(per: DataFrame) -> DataFrame:
    """``per`` with ``rank``, the place of each source by code point from 0, null last. Sources are dealt by ranges: no task has all."""
    by_name = F.col("source").asc_nulls_last()
    ranged = written(per.repartitionByRange(by_name).withColumn("part", F.spark_partition_id()), "mix-ranges")
    offsets, total = [], 0
    for r in sorted(ranged.groupBy("part").count().collect()):  # one row a partition
        offsets.append((r["part"], total))
        total += r["count"]
    table = per.sparkSession.createDataFrame(offsets, "part int, before long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(by_name)) - 1
    return ranged.withColumn("within", within).join(F.broadcast(table), "part").withColumn("rank", F.col("before") + F.col("within")).drop("part", "before", "within")


def targets(sized: DataFrame, share: float = SHARE, limit: float = LIMIT, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, n, target`` from ``source, size``: one row a source, as a stored table.

    Sources by code point, null last, get the weights in turn and share ``share`` times all sizes by weight;
    none gets over ``limit`` times its size, and what is over is shared by weight among the others again, until none is
    above: a pass of sums over the sources each time, in which the level (words for a weight of one) rises. A source is full
    where ``limit * size / weight`` is under the level."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    per = written(ranked(per).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank"), "mix-sources")
    full = F.col("source_size") * F.lit(limit)
    ratio, level, seen = full / F.col("weight"), -1.0, None
    while True:
        is_full = ratio < F.lit(level)
        r = per.agg(F.sum("source_size"), F.sum(F.when(is_full, F.col("source_size"))), F.sum(F.when(~is_full, F.col("weight"))), F.count_if(is_full)).first()
        if r[3] == seen or not r[2]:
            break
        seen, level = r[3], ((r[0] or 0) * share - (r[1] or 0) * limit) / r[2]
    return written(per.select("source", "source_size", "n", F.when(ratio < F.lit(level), full).otherwise(F.lit(max(level, 0.0)) * F.col("weight")).alias("target")), "mix-targets")


def dealt(df: DataFrame, per: DataFrame, leaf: int) -> DataFrame:
    """``df`` (with source, size, key) and its source's numbers and the leaf of each row."""
    name = {"__s": F.coalesce("source", F.lit("")), "__none": F.col("source").isNull()}
    left, right = df.withColumns(name), per.withColumns(name).drop("source")
    rows = left.join(F.broadcast(right), ["__s", "__none"]) if per.count() <= 100_000 else meet(left, right, ["__s", "__none"])
    leaves = F.ceil(F.col("n") / leaf)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return rows.withColumn("leaf", F.pmod(F.xxhash64("key"), leaves)).withColumn("copies", copies).withColumn("group", F.xxhash64("__s", "__none"))


def apart(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that agree in all columns, one of them ``key``, as rows with keys of their own, which go to different leaves: counted
    before the shuffle, and numbered."""
    counted = written(rows.groupBy(*columns).agg(F.count("*").alias("same")), "mix-sizes")
    most = counted.agg(F.max("same")).first()[0] or 0
    return each_copy(counted, "same", ["key"], "copy", most).withColumn("key", F.xxhash64("key", "copy")).drop("same", "copy")


def settle(size: np.ndarray, copies: float, group: int, leaf: int) -> tuple[np.ndarray, int, float]:
    """Whole copies of a leaf's rows, the row that is left (-1: none) and its fraction."""
    whole = int(copies + TINY)
    p = np.full(len(size), max(0.0, copies - whole))
    done, held = pivot(size, p, (group, leaf, 0))
    return done + whole, held, float(p[held]) if held >= 0 else 0.0


NODE = pa.schema([("group", pa.int64()), ("leaf", pa.int64()), ("size", pa.int64()), ("p", pa.float64()), ("node", pa.int64()), ("up", pa.int64()), ("open", pa.bool_())])


def combiner(depth: int, last: bool) -> Callable[[tuple, pa.Table], pa.Table]:
    """Rounds the rests that meet in a node: each one's ``up``, and which one is left (``open``); the last node leaves none."""

    def combine(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("leaf")
        p = rows.column("p").to_numpy().copy()
        salt = key[0].as_py(), key[1].as_py(), depth
        up, held = pivot(rows.column("size").to_numpy(), p, salt)
        left = np.arange(len(p)) == held
        if last and held >= 0:
            up[held] = chance(*salt, -1) < p[held]
            left[held] = False
        return pa.Table.from_arrays([*(rows.column(c) for c in ("group", "leaf", "size")), pa.array(p), rows.column("node"), pa.array(up), pa.array(left)], schema=NODE)

    return combine


def rests(leaves: DataFrame) -> DataFrame:
    """``group, leaf, up``: for the row that each leaf has left, whether it is rounded up. Input: group, leaf, size, p."""
    level, done = leaves.withColumn("node", F.col("leaf")), None
    depth = 0
    while True:
        depth += 1
        level = level.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        top = level.agg(F.max("node")).first()[0]
        if top is None:
            break

        out = written(level.groupBy("group", "node").applyInArrow(combiner(depth, top == 0), "group long, leaf long, size long, p double, node long, up long, open boolean"), "mix-rests")
        settled = out.filter(~F.col("open")).select("group", "leaf", "up")
        done = settled if done is None else done.union(settled)
        if top == 0:
            break
        level = out.filter("open").select("group", "leaf", "size", "p", "node")
    return done if done is not None else leaves.select("group", "leaf", F.lit(0).cast("long").alias("up"))


def leaf_rests(rows: DataFrame) -> DataFrame:
    """``group, leaf, size, p``: the row that each leaf has left and its fraction."""

    def of_leaf(key: tuple, leaf: pa.Table) -> pa.Table:
        leaf = leaf.sort_by(ORDER)
        size = leaf.column("size").to_numpy()
        _, held, p = settle(size, leaf.column("copies")[0].as_py(), *(k.as_py() for k in key))
        out = [(key[0].as_py(), key[1].as_py(), int(size[held]), p)] if held >= 0 else []
        return pa.Table.from_arrays([pa.array([r[k] for r in out], NODE.field(k).type) for k in range(4)], schema=pa.schema([NODE.field(k) for k in range(4)]))

    narrow = rows.select("group", "leaf", "key", "size", "copies")
    return narrow.groupBy("group", "leaf").applyInArrow(of_leaf, "group long, leaf long, size long, p double")


def rounded(rows: DataFrame, emit: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``emit(rows of a leaf, copies of each)`` over all leaves, once the tree has settled the leaves' rests."""
    ups = written(rests(written(leaf_rests(rows), "mix-leaves")), "mix-ups").withColumnsRenamed({"group": "g", "leaf": "l"})
    with_up = rows.join(F.broadcast(ups) if ups.count() <= 100_000 else ups, (rows["group"] == ups["g"]) & (rows["leaf"] == ups["l"]), "left").drop("g", "l")

    def of_leaf(key: tuple, leaf: pa.Table) -> pa.Table:
        leaf = leaf.sort_by(ORDER)
        copies, held, _ = settle(leaf.column("size").to_numpy(), leaf.column("copies")[0].as_py(), *(k.as_py() for k in key))
        if held >= 0:
            copies[held] += leaf.column("up")[0].as_py()
        return emit(leaf, copies)

    return with_up.groupBy("group", "leaf").applyInArrow(of_leaf, schema)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, limit: float = LIMIT, weights: tuple[int, ...] = WEIGHTS, leaf: int = LEAF) -> DataFrame:
    """``id_col, size, source_size, target, taken`` for each row of ``df``.

    size: words of the text (null: 0). taken: words the mix takes of it, its size times its copies, repeats
    counted. Null sources are one source. Ids may be null or repeated: rows are told apart by id and text, and
    equal rows are alike. Other columns are not read. Texts are read once and never shuffled."""
    text = df[text_col]
    sized = df.select(df[id_col].alias("id"), df[source_col].alias("source"), words(text).alias("size"), F.xxhash64(df[id_col], text).alias("key"))
    sized = apart(sized, ["id", "source", "size", "key"])
    rows = dealt(sized, targets(sized, share, limit, weights), leaf)
    kind = df.schema[id_col].dataType.simpleString()

    def emit(leaf: pa.Table, copies: np.ndarray) -> pa.Table:
        return leaf.select(["id", "size", "source_size", "target"]).append_column("taken", pa.array(leaf.column("size").to_numpy() * copies))

    keep = rows.select("id", "size", "source_size", "target", "key", "leaf", "copies", "group")
    return rounded(keep, emit, f"id {kind}, size long, source_size long, target double, taken long").withColumnRenamed("id", id_col)


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = SHARE, limit: float = LIMIT, weights: tuple[int, ...] = WEIGHTS, leaf: int = LEAF) -> DataFrame:
    """``df`` with each row repeated as often as the mix takes it. Columns as in ``df``; texts are not sent through Python."""
    names = df.columns
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    ident = F.xxhash64(*(F.col(f"`{c}`") for c in names))
    wide = df.select(row.alias("row"), df[source_col].alias("source"), words(df[text_col]).alias("size"), F.xxhash64(df[id_col], df[text_col]).alias("key"), ident.alias("ident"))
    sized = apart(wide.select("source", "size", "key", "ident"), ["source", "size", "key", "ident"])
    rows = dealt(sized, targets(sized, share, limit, weights), leaf).select("size", "key", "leaf", "copies", "group", "ident")

    def emit(leaf: pa.Table, copies: np.ndarray) -> pa.Table:
        return leaf.select(["ident"]).append_column("copies", pa.array(copies))

    taken = rounded(rows, emit, "ident long, copies long").groupBy("ident").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    taken = written(taken, "mix-taken")
    # rows that agree in every column are one before the shuffle, and are repeated after it
    found = wide.select("row", "ident").dropDuplicates(["ident"]).join(taken, "ident")
    most = taken.agg(F.max("copies")).first()[0] or 0
    return each_copy(found, "copies", ["ident"], "copy", most).select("row.*")
