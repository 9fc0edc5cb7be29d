"""Toxicity by a noisy channel: restore disguised words, then score the restored text.

A token that is not plain letters, or has a letter twice in a row, becomes a lattice: symbols
stand for letters or for nothing, repeated letters may be typed once, masked letters may be any
vowel. Viterbi decoding under a character trigram model picks the reading. Runs of single
letters are read as one token. Plain tokens are lattices with one path and need no decoding.

Score: the restored tokens are looked up by their prefixes in a lexicon of log-odds, and a
logistic regression on the hits gives a probability.

Everything is learned from all labelled rows that it is given: counts of letters and features are
summed by Spark, and so are the sums of each Newton step. Language, source and id are no inputs of
a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelode.llm import slices
from framelode.scratch import written

MAX_LEXICON, MIN_SUPPORT, MIN_Z, MIN_ODDS = 1 << 16, 5, 4.5, 1.5
FEW_LABELS = 1 << 20  # labels that may be broadcast
THRESHOLD = 0.7
PREFIXES = range(4, 10)
CACHE = 200_000
KNOWN, HELD = 1 << 16, 1 << 17  # tokens and features that a task holds while it counts
UNIT = float(1 << 30)
SPACED = 16
HEAD = 6

# Letters that symbols stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i",
}
MASKS = frozenset("*#%?")

# The model's alphabet: word boundary, a-z, the small letters from U+00DF to U+00FF, anything else.
LETTERS = {chr(c): k + 1 for k, c in enumerate([*range(97, 123), *range(0xDF, 0x100)])}
SIZE = len(LETTERS) + 2
OTHER = SIZE - 1


def code(c: str) -> int:
    return LETTERS.get(c, OTHER)


def edges_off(token: str) -> str:
    """The token from its first to its last letter or digit."""
    s, e = 0, len(token)
    while s < e and not token[s].isalnum():
        s += 1
    while e > s and not token[e - 1].isalnum():
        e -= 1
    return token[s:e]


def plain(core: str) -> bool:
    return core.isalpha() and not any(a == b for a, b in zip(core, core[1:], strict=False))


def trigram_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of a letter after two others, with Witten-Bell interpolation."""
    three = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)

    def mixed(n: np.ndarray, lower: np.ndarray) -> np.ndarray:
        kinds, total = (n > 0).sum(-1, keepdims=True), n.sum(-1, keepdims=True)
        return np.where(total > 0, (n + kinds * lower) / np.maximum(total + kinds, 1), lower)

    one = mixed(three.sum((0, 1)), np.full(SIZE, 1 / SIZE))
    two = mixed(three.sum(0), one[None, :])
    return -np.log(mixed(three, two[None, :, :])).astype(np.float32)


def readings(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each character the letters it may stand for, or nothing, with their costs."""
    n = len(token)
    first = next((i for i, c in enumerate(token) if c.isalpha()), n)
    last = next((i for i in range(n - 1, -1, -1) if token[i].isalpha()), -1)
    out = []
    for i, c in enumerate(token):
        if c.isalpha():
            options = [(c, 0.0)]
            if i and token[i - 1] == c:
                long = (i > 1 and token[i - 2] == c) or (i + 1 < n and token[i + 1] == c)
                options.append(("", 0.5 if long else 3.0))
        else:
            options = [(x, 1.0) for x in LEET.get(c, "")]
            if c in MASKS:
                options += [(x, 2.0) for x in "aeiou"]
            edge = i < first or i > last
            options.append(("", (6.0 if not edge or c.isdigit() else 3.5) if c in LEET else (0.5 if edge else 4.5) if c in MASKS else 4.0 if c.isalnum() else 0.3))
            if i and token[i - 1] == c and c in LEET:  # a repeated symbol
                options[-1] = ("", min(options[-1][1], 0.8))
        out.append(options)
    return out


def decode(token: str, costs: np.ndarray) -> str:
    """The cheapest reading of a token: Viterbi over pairs of letters. Empty if nothing reads as a letter.

    Linear in the token's length; ties go to the reading that sorts first."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in readings(token):
        step: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, path) in sorted(best.items()):
            row = costs[a, b]
            for letter, price in options:
                if letter:
                    k = code(letter)
                    state, total, way = (b, k), cost + price + float(row[k]), (path, letter)
                else:
                    state, total, way = (a, b), cost + price, path
                if state not in step or total < step[state][0]:
                    step[state] = (total, way)
        best = step
    _, way = min(((cost + float(costs[a, b, 0]), way) for (a, b), (cost, way) in best.items()), key=lambda x: x[0])
    letters = []
    while way:
        way, letter = way
        letters.append(letter)
    return "".join(reversed(letters))


def forms(token: str, costs: np.ndarray) -> tuple[str, ...]:
    """What a token may say: its letters as they are, and the decoded reading where the lattice has more than one path."""
    low = token.lower()
    core = edges_off(low)
    if plain(core) and (len(core) == len(low) or not any(c in LEET for c in low)):
        return (core,)
    read = decode(low, costs)
    kept = [core] if core.isalpha() else []
    return tuple(dict.fromkeys(x for x in [*kept, read] if x))


def features(form: str) -> list[str]:
    """The word itself (marked) and its prefixes."""
    return [form + "|", *(form[:k] for k in PREFIXES if k <= len(form))]


def spaced(tokens: list[str]) -> list[str]:
    """Runs of three or more single letters, joined to one token from each of their letters on, ``SPACED`` letters at most: a
    disguised word may follow words of one letter, or others of its kind."""
    out, run, after = [], [], -2

    def joined() -> list[str]:
        whole = "".join(run)
        return [whole[k : k + SPACED] for k in range(len(run) - 2)]

    for i, t in enumerate(tokens):
        if len(t) == 1 or len(t) == 2 and not t[1].isalnum():
            if i != after + 1:
                out += joined()
                run = []
            run.append(t[0])
            after = i
    return out + joined()


@dataclass
class Model:
    costs: np.ndarray
    lexicon: dict[str, float]
    weights: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Heads(dict):
    """Whether a token that starts with these characters, ``HEAD`` at most, can read as anything in the lexicon.

    Of the letters that it starts with, each stays or, after the same letter, falls away; so each reading of the token begins with
    one of these, and must begin a feature or with a prefix that is one. Heads that start with a symbol always can."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.starts = {f[:k] for f in lexicon for k in range(1, HEAD + 1)}
        self.whole = {f for f in lexicon if len(f) <= HEAD}

    def __missing__(self, head: str) -> bool:
        begun = {""}
        for i, c in enumerate(head):
            if not c.isalpha():
                break
            begun = {x + c for x in begun} | (begun if i and head[i - 1] == c else set())
        can = any(x in self.starts or any(x[:k] in self.whole for k in PREFIXES if k <= len(x)) or not x for x in begun)
        if len(self) >= CACHE:
            self.clear()
        self[head] = can
        return can


class Scorer(dict):
    """Weights by token in lower case, kept while there are not too many; ``score`` for whole texts."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.heads = model, Heads(model.lexicon)

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        get = self.model.lexicon.get
        self[token] = w = max((get(f, 0.0) for form in forms(token, self.model.costs) for f in features(form)), default=0.0)
        return w

    def hits(self, text: str | None) -> list[float]:
        """Numbers that describe a text's hits: the inputs of the regression."""
        tokens, heads = (text or "").lower().split(), self.heads
        found = [(w, t) for t in tokens if heads[t[:HEAD]] and (w := self[t])] + [(w, t) for t in spaced(tokens) if (w := self[t])]
        n = len(found)
        return [1.0, log1p(n), log1p(len({t for _, t in found})), log1p(sum(w for w, _ in found)), float(n >= 2), float(n >= 3), log1p(n) * log1p(len(tokens)) / 6]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.hits(text), self.model.weights))
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def newton_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """What rows add to a Newton step: the log-likelihood's gradient and, row by row, its curvature. In whole numbers of 1 / ``UNIT``,
    so that a sum does not depend on how the rows are dealt."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    terms = x[:, :, None] * (x * (p * (1 - p))[:, None])[:, None, :]
    return np.rint(np.concatenate([x * (y - p)[:, None], terms.reshape(len(x), -1)], axis=1) * UNIT).astype(np.int64).sum(0)


def regression(hits: DataFrame, size: int, decay: float = 1.0) -> np.ndarray:
    """Logistic regression on a stored table ``y, x`` by Newton steps, a job each, with L2 on all weights but the bias."""

    def summing(w: np.ndarray):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + size * size, np.int64)
            for b in batches:
                for s in range(0, b.num_rows, 4096):
                    part = b.slice(s, 4096)
                    total += newton_sums(part.column(1).flatten().to_numpy().reshape(-1, size), part.column(0).to_numpy(), w)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["sums"])

        return scan

    w, ridge = np.zeros(size), np.full(size, decay)
    ridge[0] = 1e-3
    for _ in range(25):
        sums = [sum(column) / UNIT for column in zip(*(r["sums"] for r in hits.mapInArrow(summing(w), "sums array<long>").collect()), strict=True)]
        step = np.linalg.solve(np.reshape(sums[size:], (size, size)) + np.diag(ridge), np.array(sums[:size]) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    return w


def by_batch(function, schema: pa.Schema):
    """A mapInArrow function from ``function(texts, labels) -> columns``; batches are 512 rows at most."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                columns = function(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return scan


CODES = np.full(256, OTHER, np.int64)
CODES[0] = 0
for _c, _k in LETTERS.items():
    CODES[ord(_c)] = _k


def letter_counts(texts: list, labels: list) -> tuple:
    words = [c for t in texts for w in (t or "").lower().split() if (c := w if w.isalpha() else edges_off(w)).isalpha()]
    points = np.frombuffer("\0\0".join(["", *words, ""]).encode("utf-32-le", "replace"), np.uint32)
    k = CODES[np.where(points > 255, 254, points)] if len(points) else CODES[:0]
    k = np.where(points > 255, OTHER, k)
    three = (k[:-2] * SIZE + k[1:-1]) * SIZE + k[2:]
    keys, counts = np.unique(three[(k[1:-1] > 0) | (k[2:] > 0)], return_counts=True)
    return keys.tolist(), counts.tolist()


def feature_counts(costs: np.ndarray):
    """A mapInArrow function from ``text, y`` to ``f, a, b``: in how many texts of label 1 and 0 a feature is. Partial counts of a task,
    given out when it holds ``HELD`` features."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_label = (Counter(), Counter())
        known: dict[str, list[str]] = {}

        def given_out() -> pa.RecordBatch:
            keys = list(by_label[0].keys() | by_label[1].keys())
            counts = [pa.array([by_label[k][f] for f in keys], pa.int64()) for k in (1, 0)]
            by_label[0].clear(), by_label[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *counts], ["f", "a", "b"])

        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    tokens = (text or "").split()
                    seen: set[str] = set()
                    for t in {*tokens, *spaced(tokens)}:
                        if t not in known:
                            if len(known) >= KNOWN:
                                known.clear()
                            core = edges_off(t.lower())
                            known[t] = [f for form in ((core,) if core.isalpha() else forms(t, costs)) for f in features(form)]
                        seen.update(known[t])
                    by_label[label].update(seen)
                    if len(by_label[0]) + len(by_label[1]) >= HELD:
                        yield given_out()
        yield given_out()

    return scan


def specific(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Without the prefixes that say no more than a clearly longer feature: under 85 % of its length, in as many texts."""
    longest: dict[str, int] = {}
    for f, (_, a) in found.items():
        word = f.rstrip("|")
        for k in range(1, len(word)):
            if (p := word[:k]) in found and a >= 0.9 * found[p][1]:
                longest[p] = max(longest.get(p, 0), len(word))
    return {f: w for f, (w, _) in found.items() if len(f) >= 0.85 * longest.get(f, 0)}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", few: int = FEW_LABELS) -> Model:
    """Learn from all rows of ``labels`` (id, 0/1) that ``docs`` has; null labels and ids are left out, a repeated id
    counts once, with its greater label and the least of its texts. Sizes on the driver are bounded: ``SIZE ** 3`` letter counts,
    ``MAX_LEXICON`` features, 56 sums a task. Up to ``few`` labels are broadcast, more are joined by a shuffle of the texts."""
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.when(F.col(label_col) > 0, 1).otherwise(0)).alias("y"))
    chosen = written(chosen, "toxicity-labels")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen) if chosen.count() <= few else chosen, "id")
    rows = rows.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")
    rows = written(rows, "toxicity-rows")

    found = rows.mapInArrow(by_batch(letter_counts, pa.schema([("k", pa.int32()), ("n", pa.int64())])), "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE**3)
    for r in found.toLocalIterator():
        counts[r["k"]] = r["n"]
    costs = trigram_costs(counts)

    by_label = dict(rows.groupBy("y").count().collect())
    n1, n0 = by_label.get(1, 0), by_label.get(0, 0)
    table = rows.mapInArrow(feature_counts(costs), "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n1 - F.col("a") + 0.5)) - F.log((F.col("b") + 0.5) / (n0 - F.col("b") + 0.5))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    kept = table.filter(F.col("a") >= MIN_SUPPORT).select("f", "a", odds.alias("w"), (odds / spread).alias("z")).filter((F.col("z") >= MIN_Z) & (F.col("w") >= MIN_ODDS))
    lexicon = specific({r["f"]: (r["w"], r["a"]) for r in kept.orderBy(F.desc("z"), "f").limit(MAX_LEXICON).collect()})

    model = Model(costs, lexicon, np.array([-5.0, 0, 0, 0, 0, 0, 0]))
    if not n1:  # certain of label 0
        return model

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([scorer.hits(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    model.weights = regression(written(rows.mapInArrow(described, "y int, x array<double>"), "toxicity-hits"), len(model.weights))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, held_out, score, predicted`` for each row of ``docs``; null and empty texts get the score of no hits.

    One narrow pass. Ids may be null or repeated; other columns are not read; an id column named like a result stands beside it.
    ``held_out``: crc32 of the id's decimal text leaves remainder 1 by 3 (null id: false)."""
    narrow = docs.select(docs[id_col], docs[text_col], held_out(docs[id_col]).alias("held_out"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in slices(batches):
            found = [scorer.score(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())], [id_col, "held_out", "score", "predicted"])

    return narrow.mapInArrow(scan, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")


def held_out(id_col) -> F.Column:
    return F.coalesce(F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def score_held_out(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """Fit on labelled rows that are not held out, then score every row."""
    id_col = columns.get("id_col", "doc_id")
    return score(docs, fit(docs, labels.filter(~held_out(F.col(id_col))), **columns), **{k: v for k, v in columns.items() if k != "label_col"})


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    at = docs.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in slices(batches):
            yield b.filter(pa.array([scorer.score(t) < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
