"""Cross-entropy difference between a target and a background language model of word bigrams.

Both models share one vocabulary: the words and runs of marks of all documents, in lower case, and the boundary of a
document. A token's probability, given the token before, backs off with Dirichlet priors to the token's share and
from there to the vocabulary, with the same weights on both sides:

    p1(w)     = (count(w) + WORDS / vocabulary) / (tokens + WORDS)
    p2(w | v) = (count(v w) + PAIRS * p1(w)) / (count(v) + PAIRS)

All counts, of pairs, words and tokens, leave the scored document out, on each side that has it: else the background
would know the rare words of every document, and the target those of its own only. A document that occurs twice is
thus known by its copy. The score is the mean over a document's tokens (the boundary at its end included) of target
loss less background loss, in nats: the lower, the more it is like the target.

Counts cover every document and grow with the corpus; nothing that grows is broadcast or sent to the driver, and texts
stay where they are read:

1. Each task cuts its documents into chunks of about ``CHUNK`` bytes and writes, for each chunk, its tokens as numbers,
   and its keys (hashes of words and pairs) in order with their counts, cut at ``n`` ranges of the key space.
2. A range's counts of all chunks meet in one task, and each chunk gets its totals back, in the order of its own keys and
   without them. A key has one number a chunk at most, so the commonest word is one of many keys of its range: a range
   holds about as many numbers as a chunk, whatever the corpus, and no key more than there are chunks.
3. A chunk's tokens and totals meet, and each of its documents is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from framelode.scratch import written

WORDS, PAIRS = 1e6, 1e4  # weights of the priors, in tokens
CHUNK = 1 << 23  # bytes of text
BATCH = 16  # rows of a chunk sent at once
PIECE = 1 << 17  # tokens in a row, and scored at once
FEW_TARGETS = 1 << 20  # ids that may be broadcast
LEAST_RANGES = 32
PIECES, BOUNDARY = re.compile(r"\w+|[^\w\s]+"), "\0\0"
SIDES = ("background", "target")


def tokens(text: str | None) -> list[str]:
    """Words and runs of marks in lower case, then the boundary."""
    return [*PIECES.findall((text or "").lower()), BOUNDARY]


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers, byte by byte of their places, compressed: small numbers take little."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_keys(x: np.ndarray) -> bytes:
    """Ascending keys, by their differences."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.uint64), dtype=np.uint64)


def word_key(word: str) -> int:
    """56 bits, even: keys of pairs are odd."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace")) >> 8 & ~1


BOUNDARY_KEY = np.uint64(word_key(BOUNDARY))


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = before * np.uint64(0x9E3779B97F4A7C15) ^ word
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(8) | np.uint64(1)


class Chunk:
    """The tokens of a chunk's documents as places in ``words``, the ascending keys of its words, and its pairs.

    ``at``: the place of each token's word among all keys of the chunk, ``pair_at`` that of its pair, ``keys`` the keys."""

    def __init__(self, words: np.ndarray, token: np.ndarray, length: np.ndarray):
        self.words, self.token, self.length = words, token, length
        self.doc = np.repeat(np.arange(len(length), dtype=np.int32), length)
        self.first = np.cumsum(length) - length
        before = np.r_[token[:1], token[:-1]]
        before[self.first] = np.searchsorted(words, BOUNDARY_KEY)
        code, pair = np.unique(before * np.int64(len(words)) + token, return_inverse=True)
        pairs, found = np.unique(pair_keys(words[code // len(words)], words[code % len(words)]), return_inverse=True)
        pair = found[pair]
        self.keys = np.concatenate([words, pairs])
        order = np.argsort(self.keys)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.keys = self.keys[order]
        self.at, self.pair_at, self.before_at = place[token], place[len(words) + pair], place[before]

    def counts(self, chosen: np.ndarray | None = None) -> np.ndarray:
        """How often each key occurs in all documents or in the chosen ones."""
        keep = slice(None) if chosen is None else chosen[self.doc]
        return np.bincount(self.at[keep], minlength=len(self.keys)) + np.bincount(self.pair_at[keep], minlength=len(self.keys))

    def pieces(self) -> Iterator[slice]:
        """Runs of documents of about ``PIECE`` tokens."""
        ends = np.cumsum(self.length)
        s = 0
        while s < len(ends):
            e = max(s + 1, int(np.searchsorted(ends, self.first[s] + PIECE, "right")))
            yield slice(s, e)
            s = e

    def tokens_of(self, docs: slice) -> slice:
        return slice(int(self.first[docs.start]), int(self.first[docs.stop - 1] + self.length[docs.stop - 1]))

    def losses(self, sides: list[tuple[np.ndarray, int, np.ndarray]], n_words: int, priors: tuple[float, float]) -> list[np.ndarray]:
        """For each side the sum of each document's losses. A side: totals of the keys, its tokens, and the documents that it has."""
        out = [np.zeros(len(self.length)) for _ in sides]
        for docs in self.pieces():
            part = self.tokens_of(docs)
            doc, at, pair_at, before_at = self.doc[part] - docs.start, self.at[part], self.pair_at[part], self.before_at[part]
            own, own_pair = (in_document(doc, x, len(self.keys)) for x in (at, pair_at))
            own_before = np.r_[own[:1], own[:-1]]  # what comes before is a token of the same document ...
            own_before[self.first[docs] - part.start] = 1  # ... or the boundary, which each has once
            for total, (counts, n_tokens, has) in zip(out, sides, strict=True):
                left_out = has[docs][doc]
                one = (counts[at] - left_out * own + priors[0] / max(n_words, 1)) / (n_tokens - left_out * self.length[docs][doc] + priors[0])
                two = (counts[pair_at] - left_out * own_pair + priors[1] * one) / (counts[before_at] - left_out * own_before + priors[1])
                total[docs] = np.bincount(doc, -np.log(two), docs.stop - docs.start)
        return out


def in_document(doc: np.ndarray, at: np.ndarray, keys: int) -> np.ndarray:
    """How often each token's key occurs in the token's document."""
    _, where, n = np.unique(doc * np.int64(keys) + at, return_inverse=True, return_counts=True)
    return n[where]


def cut(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of ``ranges`` equal parts of the key space starts among ascending keys, and the end."""
    return np.searchsorted(keys >> np.uint64(24), np.array([-(-(k << 32) // ranges) for k in range(ranges)] + [1 << 32], np.uint64))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK, priors: tuple[float, float] = (WORDS, PAIRS)) -> DataFrame:
    """``id_col, n_tokens, ce_diff`` for each row of ``docs``: its tokens and the boundary, and the mean loss difference.

    ``target`` has the ids of target documents: nulls and repeats do no harm, each row with such an id counts. An empty
    target is a uniform model. Null and empty texts have one token, the boundary. Ids may be null or repeated; rows that
    agree are copies, which know each other; other columns are not read. Up to
    ``FEW_TARGETS`` target ids are broadcast, more are joined with the documents by a shuffle. One text is held by one task, whatever its length."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType
    wanted = target.select(target[id_col].cast(kind).alias("id")).filter("id IS NOT NULL").distinct().withColumn("wanted", F.lit(True))
    wanted = F.broadcast(wanted) if wanted.count() <= FEW_TARGETS else wanted
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // chunk_bytes))
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("keys", pa.binary()), *((s, pa.binary()) for s in SIDES), ("ids", pa.list_(to_arrow_type(kind))), ("wanted", pa.list_(pa.bool_())), ("length", pa.binary()), ("token", pa.binary())])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        ids, flags, length, token, place = [], [], [], [], {}

        def whole() -> Iterator[pa.RecordBatch]:
            words, rank = np.unique(np.fromiter(map(word_key, place), np.uint64, len(place)), return_inverse=True)
            c = Chunk(words, rank[np.concatenate(token)].astype(np.int32), np.array(length))
            sides = c.counts(), c.counts(np.array(flags))
            at = cut(c.keys, ranges)
            out = [(number, k, packed_keys(c.keys[s:e]), *(packed(x[s:e]) for x in sides), None, None, None, None) for k, (s, e) in enumerate(zip(at, at[1:], strict=False)) if e > s]
            pieces = list(c.pieces())
            for k, (docs, own) in enumerate(zip(pieces, np.array_split(words, len(pieces)), strict=True)):
                token_piece = c.token[c.tokens_of(docs)].astype(np.int64)
                out.append((number, -1 - k, packed_keys(own), None, None, ids[docs], flags[docs], packed(c.length[docs]), packed(token_piece)))
            for k in range(0, len(out), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out[k : k + BATCH], strict=True), schema, strict=True)], schema=schema)

        for i, text, flag in (row for b in batches for s in range(0, b.num_rows, 256) for row in zip(*(b.column(k).slice(s, 256).to_pylist() for k in range(3)), strict=True)):
            found = tokens(text)
            token.append(np.fromiter((place.setdefault(w, len(place)) for w in found), np.int32, len(found)))
            ids.append(i), flags.append(bool(flag)), length.append(len(found))
            held += len(text or "")
            if held >= chunk_bytes:
                yield from whole()
                number, held = number + 1, 0
                ids, flags, length, token, place = [], [], [], [], {}
        if ids:
            yield from whole()

    fields = f"chunk long, part long, keys binary, background binary, target binary, ids array<{kind.simpleString()}>, wanted array<boolean>, length binary, token binary"
    cut_up = written(rows.join(wanted, "id", "left").select("id", "text", "wanted").mapInArrow(chunks, fields), "lm-chunks", packed=True)

    def add(part: pa.Table) -> pa.Table:
        """Each chunk's totals in the order of its keys, and a row with the range's words and tokens."""
        keys = [unpacked_keys(x.as_py()) for x in part.column("keys")]
        all_keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        is_word = all_keys % np.uint64(2) == 0
        back, sums = [part.column("chunk").combine_chunks()], [int(is_word.sum())]
        for s in SIDES:
            total = np.bincount(place, np.concatenate([unpacked(x.as_py()) for x in part.column(s)]), len(all_keys)).astype(np.int64)
            back.append(pa.array([packed(total[p]) for p in np.split(place, ends[:-1])], pa.binary()))
            sums.append(int(total[is_word].sum()))
        n = part.num_rows
        out = pa.Table.from_arrays([back[0], part.column("part").combine_chunks(), *back[1:], *(pa.nulls(n, pa.int64()) for _ in sums)], schema=sent)
        return pa.concat_tables([out, pa.Table.from_pylist([{"chunk": -1, "part": -1, "words": sums[0], "background_n": sums[1], "target_n": sums[2]}], schema=sent)])

    sent = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), *((s, pa.binary()) for s in SIDES), ("words", pa.int64()), *((f"{s}_n", pa.int64()) for s in SIDES)])
    counted = cut_up.filter("part >= 0").select("chunk", "part", "keys", *SIDES)
    totals = written(counted.groupBy("part").applyInArrow(add, "chunk long, part long, background binary, target binary, words long, background_n long, target_n long"), "lm-totals", packed=True)
    n_words, *n_tokens = (x or 0 for x in totals.filter("chunk = -1").agg(F.sum("words"), *(F.sum(f"{s}_n") for s in SIDES)).first())
    result = pa.schema([("id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ce_diff", pa.float64())])

    def score(chunk: pa.Table, found: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return result.empty_table()
        chunk = chunk.sort_by([("part", "descending")])
        words, token, length = (np.concatenate([f(x.as_py()) for x in chunk.column(n)]) for f, n in ((unpacked_keys, "keys"), (unpacked, "token"), (unpacked, "length")))
        c = Chunk(words, token.astype(np.int32), length)
        flags = np.array([x for piece in chunk.column("wanted") for x in piece.as_py()], bool)
        order = np.argsort(found.column("part").to_numpy())
        sides = [(np.concatenate([unpacked(found.column(s)[int(k)].as_py()) for k in order]), n, has) for s, n, has in zip(SIDES, n_tokens, (np.ones(len(flags), bool), flags), strict=True)]
        loss = c.losses(sides, n_words, priors)
        mean = (loss[1] - loss[0]) / c.length
        return pa.Table.from_arrays([chunk.column("ids").combine_chunks().flatten(), pa.array(c.length), pa.array(np.round(mean, 9))], schema=result)

    texts = cut_up.filter("part < 0").select("chunk", "part", "keys", "ids", "wanted", "length", "token")
    scored = texts.groupBy("chunk").cogroup(totals.filter("chunk >= 0").select("chunk", "part", *SIDES).groupBy("chunk")).applyInArrow(score, f"id {kind.simpleString()}, n_tokens long, ce_diff double")
    return scored.withColumnRenamed("id", id_col)
