"""Benchmark decontamination by spaced-seed hashing.

Texts are read as tokens: runs of letters and digits in lower case; every code point outside ASCII
counts as a letter. A seed is a fixed mask that leaves some places out, so that a window with substituted tokens there
has the same hash. Seed hashes of benchmark windows join those of training windows; each diagonal (text place
less item place) with a hit is then compared token by token.

One rule for items of all lengths: a match is a stretch of a diagonal that starts and ends with an equal token, has
``min_tokens`` tokens or more (an item with fewer: all of its tokens) and at least ``min_identity`` of them equal. So an item
of one token matches every text that has it. The masks hit every window of 12 to 20 tokens with a quarter of them
substituted, and every window of an item's length below 12, whatever the places: within these bounds nothing is missed.

Scale: a benchmark of up to ``BLOCK`` tokens (its size is checked first) goes to the executors whole, and one narrow
pass over the training texts finds all, with no shuffle. A larger one stays in tables: training windows pass a bit
table of ``2 ** BITS`` bits, what is left joins the benchmark's windows, and only texts with a hit meet the items that they hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.llm import slices
from framelode.scratch import written

# The masks, a 1 for each place that a seed reads, by the least number of tokens of their items.
MASKS = {12: ("11111", "111011", "110111", "11001011", "110100011"), 4: ("111", "1101", "1011"), 3: ("111",), 2: ("11",), 1: ("1",)}
MIN_TOKENS, MIN_IDENTITY = 12, 0.75
BLOCK = 1 << 20
BITS = 24
CHUNK = 1 << 20  # bytes of text hashed at once
PAIRS = 1 << 20  # hits listed at once

TOKEN = np.zeros(256, bool)
TOKEN[48:58] = TOKEN[65:91] = TOKEN[97:123] = TOKEN[128:] = True
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
PLACES = np.random.default_rng(11).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def all_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return all_powers(int(base), max(2 * CHUNK, 1 << n.bit_length()))[:n]


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode()


def tokens(data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens in ``data``, whose texts start at ``bounds[:-1]``, and the first token of each text."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = TOKEN[raw]
    before = np.r_[False, inside[:-1]]
    cut = np.zeros(n, bool)
    cut[bounds[:-1][bounds[:-1] < n]] = True
    starts = np.flatnonzero(inside & (~before | cut))
    after = np.r_[inside[1:], False]
    last = np.r_[cut[1:], True]
    ends = np.flatnonzero(inside & (~after | last)) + 1
    values = (raw.astype(np.uint64) + np.uint64(1)) * powers(MULTIPLIER, n)
    total = np.r_[np.uint64(0), np.cumsum(values, dtype=np.uint64)]
    back = powers(INVERSE, n)
    return mixed((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, bounds)


def seeds(t: np.ndarray, mask: str) -> np.ndarray:
    """The hash of each window of ``len(mask)`` tokens at the mask's places; windows of different masks differ."""
    n = len(t) - len(mask) + 1
    out = np.full(max(n, 0), int(mask, 2), np.uint64)
    for k, c in enumerate(mask):
        if c == "1" and n > 0:
            out += t[k : k + n] * PLACES[k]
    return mixed(out)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for an item of ``n`` tokens."""
    return next((m for least, m in MASKS.items() if n >= least), ())


def repeated(s: np.ndarray) -> np.ndarray:
    """Whether a window is the same as the one before it."""
    return np.r_[False, s[1:] == s[:-1]] if len(s) else np.zeros(0, bool)


def stretch(same: np.ndarray, least: int, min_identity: float) -> tuple[int, int, int] | None:
    """The longest stretch of ``same`` that starts and ends with an equal token, of ``least`` tokens or more and with the
    identity asked for: start, end, substitutions. Ties: fewer substitutions, then the first."""
    if np.count_nonzero(same) < least * min_identity:
        return None
    q = round(min_identity * 1000)
    total = np.r_[0, np.cumsum(np.where(same, 1000 - q, -q))]
    after_equal = np.where(np.r_[False, same], total, -1000 * len(total))
    most = np.maximum.accumulate(after_equal[::-1])[::-1]  # of an end and all after it: falls
    starts = np.flatnonzero(same)
    ends = len(most) - np.searchsorted(most[::-1], total[starts])  # one past the last end whose total is as high
    length = ends - 1 - starts
    best = length.max()
    if best < least:
        return None
    wrong, s = min((int(best - np.count_nonzero(same[s : s + best])), int(s)) for s in starts[length == best])
    return s, s + int(best), wrong


class Benchmark:
    """Items' tokens, with ids in order, and for each mask the sorted hashes of their windows with item and place."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, t in items if len(t)]
        self.tokens = [t for _, t in items if len(t)]
        self.tables = []
        for m in dict.fromkeys(m for t in self.tokens for m in masks_of(len(t))):
            rows = [(seeds(t, m), k) for k, t in enumerate(self.tokens) if m in masks_of(len(t))]
            keys = np.concatenate([s for s, _ in rows])
            item = np.repeat([k for _, k in rows], [len(s) for s, _ in rows])
            place = np.concatenate([np.arange(len(s)) for s, _ in rows])
            again = np.concatenate([repeated(s) for s, _ in rows])
            order = np.lexsort((again, keys))
            keys, again = keys[order], again[order]
            bits = np.zeros(1 << 20, bool)  # most windows stop here
            bits[(keys >> np.uint64(44)).astype(np.int64)] = True
            new = np.r_[0, np.cumsum(~again)]
            self.tables.append((m, keys, item[order], place[order], new, bits))

    def diagonals(self, t: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows ``text, item, shift``, in order, of diagonals with equal seed hashes; ``first``: where each text's tokens start in ``t``.

        Runs of one repeated window meet at their first windows only, which lie on all of their diagonals; hits are listed ``PAIRS`` at once."""
        found = [np.zeros((0, 3), np.int64)]
        for m, keys, item, place, new, bits in self.tables:
            if len(t) < len(m):
                continue
            s = seeds(t, m)
            at = np.flatnonzero(bits[(s >> np.uint64(44)).astype(np.int64)])
            text = np.searchsorted(first, at, "right") - 1
            inside = at + len(m) <= first[text + 1]
            at, text = at[inside], text[inside]
            again = repeated(s)[at] & (at > first[text])
            lo, hi = np.searchsorted(keys, s[at]), np.searchsorted(keys, s[at], "right")
            n = np.where(again, new[hi] - new[lo], hi - lo)
            hit = n > 0
            at, text, lo, n = at[hit], text[hit], lo[hit], n[hit]
            ends = np.cumsum(n)
            s = 0
            while s < len(at):
                e = max(s + 1, int(np.searchsorted(ends, ends[s] - n[s] + PAIRS, "right")))
                each = np.repeat(np.arange(s, e), n[s:e])
                row = lo[each] + np.arange(len(each)) - np.repeat(ends[s:e] - n[s:e] - (ends[s] - n[s]), n[s:e])
                found.append(np.unique(np.stack([text[each], item[row], at[each] - first[text[each]] - place[row]], 1), axis=0))
                if len(found) > 64:
                    found = [np.unique(np.concatenate(found), axis=0)]
                s = e
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, t: np.ndarray, diagonals: np.ndarray, min_tokens: int, min_identity: float, any_one: bool = False) -> dict[int, tuple[int, int, int, int]]:
        """By item the longest match of a text on rows ``item, shift`` in order: text token, item token, tokens, substitutions.
        Ties: fewer substitutions, then the first place. ``any_one``: the first match will do."""
        found: dict[int, tuple[int, int, int, int]] = {}
        whole = -1
        for item, shift in diagonals.tolist():
            if item == whole:
                continue  # the whole item was found, without substitutions and further to the front
            own = self.tokens[item]
            lo, hi = max(0, -shift), min(len(own), len(t) - shift)
            if (m := stretch(own[lo:hi] == t[lo + shift : hi + shift], min(min_tokens, len(own)), min_identity)) is None:
                continue
            row = lo + m[0] + shift, lo + m[0], m[1] - m[0], m[2]
            if item not in found or (-row[2], row[3], row[0], row[1]) < (-found[item][2], found[item][3], found[item][0], found[item][1]):
                found[item] = row
            if row[2] == len(own) and not row[3]:
                whole = item
            if any_one:
                break
        return found


def matched(bench: Benchmark, texts: list[str | None], min_tokens: int, min_identity: float, any_one: bool = False) -> Iterator[tuple[int, dict[int, tuple[int, int, int, int]]]]:
    """``(place, matches by item)`` of the texts that have any; texts are hashed together, ``CHUNK`` bytes or one text at once."""
    for s, t, first in tokenized(texts):
        rows = bench.diagonals(t, first)
        for k, e in pairwise([*np.flatnonzero(np.diff(rows[:, 0], prepend=-1)), len(rows)]):
            text = int(rows[k, 0])
            if found := bench.matches(t[first[text] : first[text + 1]], rows[k:e, 1:], min_tokens, min_identity, any_one):
                yield s + text, found


def tokenized(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of texts: the first one's place, the hashes of their tokens, and where each one's start."""
    s = 0
    while s < len(texts):
        parts, bounds, e = [], [0], s
        while e < len(texts) and (e == s or bounds[-1] < CHUNK):
            parts.append(folded(texts[e]))
            bounds.append(bounds[-1] + len(parts[-1]))
            e += 1
        yield s, *tokens(b"".join(parts), np.array(bounds))
        s = e


def item_tokens(text: str | None) -> np.ndarray:
    data = folded(text)
    return tokens(data, np.array([0, len(data)]))[0]


def in_memory(items: DataFrame, limit: int) -> Benchmark | None:
    """The benchmark ``item, text``, if its texts have ``limit`` tokens at most by their length; null ids are left out."""
    size = items.agg(F.sum(F.octet_length("text") / 2 + 1)).first()[0] or 0
    if size > limit:
        return None
    return Benchmark([(r["item"], item_tokens(r["text"])) for r in sorted(items.collect(), key=lambda r: (r["item"], r["text"] or ""))])


def in_tables(docs: DataFrame, items: DataFrame, min_tokens: int, min_identity: float, any_one: bool) -> DataFrame:
    """``key, item, a, b, c, d`` for ``docs (key, text)`` and ``items (item, text)`` of any size, by joins on seed hashes.

    Rows of one key have one text, and give one row for each item."""
    items = items.withColumn("own", F.xxhash64("item", "text"))

    def item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = item_tokens(text)
                for m in masks_of(len(t)):
                    h = seeds(t, m)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), own, np.int64)), pa.array(np.arange(len(h))), pa.array(np.full(len(h), int(m, 2), np.int32))], ["h", "own", "place", "mask"])

    known = written(items.select("own", "text").distinct().mapInArrow(item_seeds, "h long, own long, place long, mask int"), "item-seeds")
    bits = np.zeros(1 << BITS, bool)
    for b in known.select(F.shiftrightunsigned("h", 64 - BITS).cast("int").alias("p")).distinct().toArrow().to_batches():  # 2 ** BITS at most
        bits[b.column(0).to_numpy()] = True
    masks = [np.binary_repr(r["mask"]) for r in known.select("mask").distinct().collect()]  # one of a few
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def doc_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            for s, t, first in tokenized(b.column(1).to_pylist()):
                for m in masks:
                    h = seeds(t, m)
                    at = np.flatnonzero(there[(h >> np.uint64(64 - BITS)).astype(np.int64)])
                    text = np.searchsorted(first, at, "right") - 1
                    inside = at + len(m) <= first[text + 1]
                    at, text = at[inside], text[inside]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(s + text)), pa.array(h[at].view(np.int64)), pa.array(at - first[text])], ["key", "h", "at"])

    hits = docs.select("key", "text").mapInArrow(doc_seeds, "key long, h long, at long")
    pairs = hits.join(known.select("h", "own", "place"), "h").select("key", "own", (F.col("at") - F.col("place")).alias("shift")).distinct()
    met = written(pairs.join(items.select("own", "item", F.col("text").alias("item_text")).distinct(), "own").select("key", "item", "own", "item_text", "shift"), "hits")

    def verify(texts: pa.Table, hit: pa.Table) -> pa.Table:
        rows = []
        if texts.num_rows and hit.num_rows:
            t = item_tokens(texts.column("text")[0].as_py())
            names: dict[tuple[int, int], int] = {}
            items = []
            for item, own, text in zip(hit.column("item").to_pylist(), hit.column("own").to_pylist(), hit.column("item_text").to_pylist(), strict=True):
                if (item, own) not in names:
                    names[item, own] = len(items)
                    items.append((item, item_tokens(text)))
            bench = Benchmark([])
            bench.tokens = [x for _, x in items]
            at = [names[x] for x in zip(hit.column("item").to_pylist(), hit.column("own").to_pylist(), strict=True)]
            diagonals = np.unique(np.stack([np.array(at), hit.column("shift").to_numpy()], 1), axis=0)
            found = bench.matches(t, diagonals, min_tokens, min_identity, any_one)
            rows = [(texts.column("key")[0].as_py(), items[k][0], *m) for k, m in found.items()]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], ["key", "item", "a", "b", "c", "d"])

    wanted = docs.select("key", "text").join(met.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    return wanted.groupBy("key").cogroup(met.groupBy("key")).applyInArrow(verify, "key long, item long, a long, b long, c long, d long")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = MIN_TOKENS, min_identity: float = MIN_IDENTITY, limit: int = BLOCK) -> DataFrame:
    """A row for each document and item that overlap: ``id_col, item_col, doc_token, item_token, n_tokens, n_substituted``,
    of the longest overlap (ties: fewer substitutions, then the first place).

    Null texts and items have no tokens; null item ids are left out; rows with the same id are looked at one by one, and
    so are items of one id with different texts. Null ids of documents are kept. An empty table on either side gives no rows. Other columns are not read."""
    narrow = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind, item_kind = narrow.schema[0].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[item_text_col].alias("text")).filter("item IS NOT NULL")
    bench = in_memory(items, limit)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, bench.ids[item], *m) for k, found in matched(bench, b.column(1).to_pylist(), min_tokens, min_identity) for item, m in sorted(found.items())]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(1, 6))], ["id", "item", "a", "b", "c", "d"])

    if bench is not None:
        found = narrow.mapInArrow(scan, f"id {kind}, item long, a long, b long, c long, d long")
    else:
        keyed = narrow.withColumn("key", F.xxhash64("id", "text"))
        found = in_tables(keyed, items, min_tokens, min_identity, False).join(keyed.select("key", "id"), "key").select("id", "item", "a", "b", "c", "d")
    return found.select(F.col("id").alias(id_col), F.col("item").cast(item_kind).alias(item_col), F.col("a").alias("doc_token"), F.col("b").alias("item_token"), F.col("c").alias("n_tokens"), F.col("d").alias("n_substituted"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_tokens: int = MIN_TOKENS, min_identity: float = MIN_IDENTITY, limit: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that overlap with a benchmark item. Columns as in ``docs``. Null texts and items have no tokens."""
    at = docs.columns.index(text_col)
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[item_text_col].alias("text")).filter("item IS NOT NULL")
    bench = in_memory(items, limit)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            clean = np.ones(b.num_rows, bool)
            for k, _ in matched(bench, b.column(at).to_pylist(), min_tokens, min_identity, True):
                clean[k] = False
            yield b.filter(pa.array(clean))

    if bench is not None:
        return docs.mapInArrow(scan, docs.schema)
    keyed = docs.withColumn("__key", F.xxhash64(docs[text_col]))
    dirty = in_tables(keyed.select(F.col("__key").alias("key"), docs[text_col].alias("text")), items, min_tokens, min_identity, True)
    return keyed.join(dirty.select(F.col("key").alias("__key")).distinct(), "__key", "left_anti").drop("__key")
