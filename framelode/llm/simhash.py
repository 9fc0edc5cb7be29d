"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprint: 64 bits, bit set where over half of a text's shingle hashes have it set.
Shingles are ``width`` words, repeats included; ASCII letters count in lower case.

Link: two fingerprints that differ in at most ``radius`` bits. The join is exact:

1. Only distinct fingerprints are joined, so copies cost nothing.
2. Distribution: the 64 bits fall into ``radius + 2`` blocks. Two linked fingerprints agree in two
   blocks at least, so each fingerprint goes to one bucket for each pair of blocks. A bucket of
   more than ``hot`` fingerprints is split into chunks that meet in pairs.
3. In a bucket, fingerprints are sorted by Gray rank and factored into nodes of eight: a node has
   the bits that all its members share (mask and pattern), upper nodes those of their children.
   Pairs of nodes go down together; a pair is pruned when the shared bits alone differ in more
   than ``radius`` places, or when its members are already connected.
4. A bucket returns a forest, one edge for each fingerprint at most, never all pairs. Components
   over the forests are found by large-star and small-star steps on written tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.scratch import written

RADIUS, WIDTH, FANOUT = 4, 4, 8
HOT = 1 << 15
HOT_KEYS = 256
FRONTIER = 1 << 14  # pairs of nodes that go down at once, each to FANOUT ** 2 pairs at most


def shingle_hashes(text: str | None, width: int = WIDTH) -> list[int]:
    """The hash of each shingle of a text. Fewer than ``width`` words make one shingle; no words none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only; splits at 09-0D and 20 only
    if not words:
        return []
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n <= 1:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends[:n] - np.fromiter(map(len, words[:n]), np.int64, n) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42) for s, e in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]


def print_of(hashes: list[int] | np.ndarray) -> int:
    """The fingerprint of a text with these shingle hashes; none give zero."""
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], ">u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The text's fingerprint. Fewer than ``width`` words make one shingle; no words give zero."""
    return print_of(shingle_hashes(text, width))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``id_col, fp long`` (the 64 bits as a signed number) for each row of ``df``."""
    narrow = df.select(df[id_col], df[text_col])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], [id_col, "fp"])

    return narrow.mapInArrow(scan, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the Gray code's order."""
    r = x.astype(np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        r = r ^ (r >> np.uint64(k))
    return r


def shrink(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member's position) after joining a[i] and b[i]: hooking and pointer jumping."""
    while len(a):
        ra, rb = label[a], label[b]
        live = ra != rb
        if not live.any():
            break
        a, b, ra, rb = a[live], b[live], ra[live], rb[live]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


class GrayIndex:
    """Hierarchical index over fingerprints that are grouped (``group`` sorted) and in Gray order in each group."""

    def __init__(self, fp: np.ndarray, group: np.ndarray, fanout: int = FANOUT):
        self.fanout, self.mask, self.pattern, self.first, self.last = fanout, [], [], [], []
        ones, zeros = fp.copy(), ~fp
        first = np.arange(len(fp))
        last = first + 1
        while True:
            self.mask.append(ones | zeros)
            self.pattern.append(ones)
            self.first.append(first)
            self.last.append(last)
            start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            if len(start) == len(group):
                break
            size = np.diff(np.r_[start, len(group)])
            within = np.arange(len(group)) - np.repeat(start, size)
            cut = np.flatnonzero(within % fanout == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            first, last, group = first[cut], last[np.r_[cut[1:] - 1, len(last) - 1]], group[cut]
        # children of node i at level k: those whose first row lies in its range
        self.child = [None] + [np.searchsorted(self.first[k - 1], np.r_[self.first[k], len(fp)]) for k in range(1, len(self.first))]

    def connected(self, radius: int) -> np.ndarray:
        """For each row the least row of its group that it reaches over links of at most ``radius`` bits."""
        fp = self.pattern[0]
        n = len(fp)
        label = np.arange(n)
        group_end = self.last[-1][np.searchsorted(self.first[-1], label, "right") - 1]
        for step in range(1, self.fanout + 1):  # neighbours in Gray order connect most of a dense group
            a = np.arange(max(0, n - step))
            a = a[a + step < group_end[a]]
            a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= radius]
            label = shrink(label, a, a + step)
        top = len(self.first) - 1
        roots = np.flatnonzero(self.last[top] - self.first[top] > 1)
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if len(a) > FRONTIER:
                half = len(a) // 2
                stack += [(level, a[half:], b[half:]), (level, a[:half], b[:half])]
                continue
            low, high = np.minimum.reduceat(label, self.first[level]), np.maximum.reduceat(label, self.first[level])
            joined = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            a, b = a[~joined], b[~joined]
            if level == 0:
                near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
                label = shrink(label, a[near], b[near])
                continue
            child, below = self.child[level], level - 1
            wide, tall = child[a + 1] - child[a], child[b + 1] - child[b]
            each = np.repeat(np.arange(len(a)), wide * tall)
            k = np.arange(len(each)) - np.repeat(np.cumsum(wide * tall) - wide * tall, wide * tall)
            x, y = child[a][each] + k // tall[each], child[b][each] + k % tall[each]
            same = a[each] == b[each]
            keep = ~same | (x < y if below == 0 else x <= y)
            x, y = x[keep], y[keep]
            both = self.mask[below][x] & self.mask[below][y]
            keep = np.bitwise_count((self.pattern[below][x] ^ self.pattern[below][y]) & both) <= radius
            stack.append((below, x[keep], y[keep]))
        return label


def block_keys(radius: int) -> list[int]:
    """Masks of bits, one for each pair of ``radius + 2`` blocks: linked words agree under one at least."""
    n = radius + 2
    cuts = [64 * k // n for k in range(n + 1)]
    block = [sum(1 << b for b in range(s, e)) for s, e in zip(cuts, cuts[1:], strict=False)]
    return [block[i] | block[j] for i, j in combinations(range(n), 2)]


def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join of ``left`` with ``right``, a stored table of one row a key with ``n``, the rows of ``left`` that the key has
    (or more). Keys with over a part in ``HOT_KEYS`` of these rows, of which there are fewer than ``HOT_KEYS``, are broadcast, so that no task
    meets all rows of a common key."""
    total, most = right.agg(F.sum("n"), F.max("n")).first()
    limit = max(1, (total or 0) // HOT_KEYS)
    if (most or 0) <= limit:
        return left.join(right, on)
    hot = F.broadcast(right.filter(F.col("n") > limit))
    return left.join(hot, on).unionByName(left.join(hot.select(*on), on, "left_anti").join(right.filter(F.col("n") <= limit), on))


def forest(prints: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges ``a, b``, in no special order, that connect what links of at most ``radius`` bits connect.

    ``prints``: distinct ``fp``."""
    masks = block_keys(radius)
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = prints.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("t", "k"))
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("t", "k", "n", F.ceil(F.col("n") / hot).cast("int").alias("chunks"))
    sizes = written(sizes, "hot-buckets")
    if sizes.isEmpty():
        keyed = keyed.withColumn("c", F.lit(0).cast("long"))
    else:
        chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("long")
        others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: F.least(j, chunk) * F.col("chunks") + F.greatest(j, chunk))
        few = sizes.count() <= HOT_KEYS
        rest = keyed.join(F.broadcast(sizes) if few else sizes, ["t", "k"], "left_anti").withColumn("c", F.lit(0).cast("long"))
        keyed = meet(keyed, sizes, ["t", "k"]).select("fp", "t", "k", F.explode(others).alias("c")).unionByName(rest.select("fp", "t", "k", "c"))
    dealt = keyed.repartition("t", "k", "c").sortWithinPartitions("t", "k", "c")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(t: pa.Table) -> pa.RecordBatch:
            fp = t.column("fp").to_numpy().view(np.uint64)
            key = [t.column(c).to_numpy() for c in ("t", "k", "c")]
            new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in key])]
            group = np.cumsum(new)
            order = np.lexsort((gray_rank(fp), group))
            fp, group = fp[order], group[order]
            label = GrayIndex(fp, group).connected(radius)
            a = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[a].view(np.int64)), pa.array(fp[label[a]].view(np.int64))], ["a", "b"])

        held: list[pa.Table] = []
        for b in batches:  # whole buckets at a time: rows of a bucket come one after another
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            ends = np.flatnonzero(np.logical_or.reduce([t.column(c).to_numpy()[1:] != t.column(c).to_numpy()[:-1] for c in ("t", "k", "c")])) + 1
            first = [t.column(c)[0].as_py() for c in ("t", "k", "c")]
            if held and (first != [held[-1].column(c)[-1].as_py() for c in ("t", "k", "c")]):
                yield edges(pa.concat_tables(held))
                held = []
            if len(ends):
                yield edges(pa.concat_tables([*held, t.slice(0, ends[-1])]))
                held = [t.slice(ends[-1])]
            else:
                held.append(t)
        if held:
            yield edges(pa.concat_tables(held))

    return dealt.mapInArrow(join, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``fp, root``: for each node of ``edges (a, b)`` the least node it reaches (signed order).

    Large-star and small-star steps until nothing changes, on written tables. Minima are partial aggregates, and the centre
    of a large star is joined as ``meet`` does it, so that its neighbours meet in no single task."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), "least")
        large = written(meet(both.filter("b > a"), least, ["a"]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        small = meet(large, low, ["a"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = written(small.filter("a <> b").distinct(), "edges")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        seen = mark


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``id_col, fingerprint, component_id`` for each row of ``df``.

    fingerprint: 16 lower-case hex digits. component_id: the least id of the rows whose fingerprints
    are connected. Null and empty texts and texts without words have fingerprint zero and link like any
    other. Null ids count for no minimum (a component of null ids has a null component_id); repeated ids
    keep a row each. Other columns are not read; an id column named like a result stands beside it. The documents of one fingerprint, and the fingerprints of one
    component, are joined as ``meet`` does it."""
    prints = written(fingerprints(df, id_col, text_col, width).toDF("id", "fp"), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    roots = components(forest(classes.select("fp"), radius, hot))
    rooted = written(classes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", F.col("n").alias("rows")), "rooted")
    named = written(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "named")
    by_print = written(meet(rooted, named, ["root"]).select("fp", "component_id", F.col("rows").alias("n")), "by-print")
    return meet(prints, by_print, ["fp"]).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """``df`` with one row of each near-duplicate component: the least id (ties: the least row hash; of rows
    that agree in every column, one). Null ids come last. Columns as in ``df``."""
    return least_rows(df, id_col, text_col, lambda keyed: near_duplicates_keyed(keyed, **options))


def least_rows(df: DataFrame, id_col: str, text_col: str, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The row of the least key of each component; ``find`` gives ``key, component`` for rows ``key, text``."""
    ident = F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    keyed = df.select(F.struct(df[id_col].isNull().alias("none"), df[id_col].alias("id"), ident.alias("row")).alias("key"), df[text_col].alias("text"))
    found = find(keyed)
    kept = found.groupBy("component").agg(F.min("key").alias("key")).select(F.col("key.row").alias("__row"), F.coalesce(F.col("key.id").cast("string"), F.lit("")).alias("__id")).distinct()
    marked = df.withColumns({"__row": ident, "__id": F.coalesce(df[id_col].cast("string"), F.lit(""))})
    # rows that agree in every column are one before they are shuffled, by the same key as the join's
    return marked.dropDuplicates(["__row", "__id"]).join(kept, ["__row", "__id"], "left_semi").select(*df.columns)


def near_duplicates_keyed(keyed: DataFrame, width: int = WIDTH, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """``key, component`` for rows ``key, text``: component is the least fingerprint that theirs reaches."""
    prints = written(fingerprints(keyed, "key", "text", width), "fingerprints")
    roots = components(forest(prints.select("fp").distinct(), radius, hot))
    least = prints.groupBy("fp").agg(F.min("key").alias("key"))
    return least.join(roots, "fp", "left").select("key", F.coalesce("root", "fp").alias("component"))
