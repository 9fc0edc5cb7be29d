"""Mixing, toxicity, decontamination and model scoring, against plain forms and held-out labels."""

import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelode.llm import decontamination, lm_scoring, mixing, sharding, toxicity


def words_of(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def plain_targets(sizes, share=1.5, limit=2.0, weights=(5, 2, 1)):
    names = sorted((k for k in sizes if k is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        free = [k for k in names if k not in full]
        rest = left - sum(full.values())
        t = {k: rest * w[k] / sum(w[x] for x in free) for k in free}
        over = [k for k in free if t[k] > limit * sizes[k]]
        if not over:
            return full | t
        full |= {k: limit * sizes[k] for k in over}


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(4)
    names = ["a", "é", "z", "b", "😀", None]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 2, 5, 40])), "en", "a" if i % 3 == 0 else names[rng.randrange(6)], 0) for i in range(900)]
    rows += [(1, "w w", "en", "b", 0)] * 3 + [(None, None, "en", "b", 0), (5000, "w " * 20_000, "en", "z", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"size": F.lit(9), "key": F.lit("x"), "copies": F.lit(1), "leaf": F.lit(0)})


def test_mix(spark, sources):
    rows = sources.collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + words_of(r["text"])
    want = plain_targets(sizes)
    got = mixing.mix(sources, leaf=16).collect()
    again = mixing.mix(sources.repartition(5), leaf=16).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    assert len(got) == len(rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    by_size = {v: k for k, v in sizes.items()}
    taken = {}
    for r in got:
        k = by_size[r["source_size"]]
        taken[k] = taken.get(k, 0) + r["taken"]
        assert abs(r["target"] - want[k]) < 1e-6 * max(1, want[k])
    for k in sizes:
        assert abs(taken[k] - want[k]) <= max(words_of(r["text"]) for r in rows if r["source"] == k)
    assert mixing.mix(sources.limit(0)).count() == 0


def test_mixed_rows(sources):
    out = mixing.mixed_rows(sources, leaf=16)
    assert out.columns == sources.columns
    repeats = {(r["doc_id"], r["size_words"]): r["n"] for r in out.groupBy("doc_id", mixing.words(F.col("text")).alias("size_words")).agg(F.count("*").alias("n")).collect()}
    for r in mixing.mix(sources, leaf=16).groupBy("doc_id", "size").agg(F.sum("taken").alias("t")).filter("size > 0").collect():
        assert repeats.get((r["doc_id"], r["size"]), 0) * r["size"] == r["t"]


def test_mix_against_plain_tree(spark, sources):
    """Every row's words, by a plain walk down each leaf and up the tree, with fractions of words instead of arrays."""
    leaf_rows = 16
    text = F.col("text")
    keyed = sources.select(F.col("doc_id"), F.col("source"), mixing.words(text).alias("w"), F.xxhash64("doc_id", "text").alias("k"))
    counted = keyed.groupBy("doc_id", "source", "w", "k").agg(F.count("*").alias("n")).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    rows = counted.withColumn("k", F.xxhash64("k", "c")).withColumn("h", F.xxhash64("k")).withColumn("g", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())).collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["w"]
    want = plain_targets(sizes)

    def settle(things, salt):
        """Rounds ``[words, fraction]`` in pairs; the one left keeps its fraction."""
        held = None
        for i, thing in enumerate(things):
            if not 1e-9 < thing[1] < 1 - 1e-9:
                thing[1] = float(round(thing[1]))
            elif not thing[0]:
                thing[1] = float(mixing.chance(*salt, i, 1) < thing[1])
            elif held is None:
                held = i
            else:
                a, b = things[held], thing
                gain, loss = min((1 - a[1]) * a[0], b[1] * b[0]), min(a[1] * a[0], (1 - b[1]) * b[0])
                step = gain if mixing.chance(*salt, i, 0) < loss / (gain + loss) else -loss
                a[1], b[1] = a[1] + step / a[0], b[1] - step / b[0]
                still = [k for k in (held, i) if 1e-9 < things[k][1] < 1 - 1e-9]
                for k in {held, i} - {*still}:
                    things[k][1] = float(things[k][1] > 0.5)
                held = still[0] if still else None
        return held

    out = []
    for source in sizes:
        own = [r for r in rows if r["source"] == source]
        copies = want[source] / sizes[source] if sizes[source] else 0.0
        whole, leaves = int(copies + 1e-9), {}
        for r in own:
            leaves.setdefault(r["h"] % -(-len(own) // leaf_rows), []).append(r)
        level, parts = {}, {}
        for leaf, held_rows in leaves.items():
            held_rows.sort(key=lambda r: (r["k"], r["w"]))
            parts[leaf] = [[r["w"], max(0.0, copies - whole)] for r in held_rows]
            held = settle(parts[leaf], (own[0]["g"], leaf, 0))
            if held is not None:
                level[leaf] = parts[leaf][held]
        depth, top = 0, max((leaf for s in sizes for leaf in [-(-sum(r["source"] == s for r in rows) // leaf_rows) - 1]), default=0)
        while level:
            depth, top = depth + 1, top // mixing.FAN
            left = {}
            for node in {leaf // mixing.FAN**depth for leaf in level}:
                members = sorted(leaf for leaf in level if leaf // mixing.FAN**depth == node)
                held = settle([level[leaf] for leaf in members], (own[0]["g"], node, depth))
                if held is not None:
                    left[members[held]] = level[members[held]]
                    if not top:
                        level[members[held]][1] = float(mixing.chance(own[0]["g"], node, depth, -1) < level[members[held]][1])
            level = {} if not top else left
        out += [(r["doc_id"], r["w"], sizes[source], r["w"] * (whole + round(x[1]))) for leaf, held_rows in leaves.items() for r, x in zip(held_rows, parts[leaf], strict=True)]
    got = [(r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in mixing.mix(sources, leaf=leaf_rows).collect()]
    assert sorted(got, key=str) == sorted(out, key=str)


def test_many_copies_of_a_row(spark):
    """Copies of one row are spread over leaves, come back whole, and share the source's words."""
    df = spark.createDataFrame([(7, "a b c", "en", "x", 5)] * 900 + [(k, "d " * (k % 5), "en", "y", 5) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    sized = mixing.apart(df.select("source", F.lit(3).cast("long").alias("size"), F.lit(1).cast("long").alias("key")), ["source", "size", "key"])
    assert sized.count() == 960 and sized.select("source", "key").distinct().count() == 960
    got = [r for r in mixing.mix(df, leaf=32).collect() if r["doc_id"] == 7 and r["size"] == 3]
    assert len(got) == 900 and all(r["taken"] in (0, 3, 6) for r in got)
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 3
    rows = [r for r in mixing.mixed_rows(df, leaf=32).collect() if r["doc_id"] == 7 and r["text"] == "a b c"]
    assert 3 * len(rows) == sum(r["taken"] for r in got)
    pieces = sharding.each_copy(spark.createDataFrame([(1, 10), (2, 3), (3, 0)], "k int, n long"), "n", ["k"], "i", 10, 4)
    assert sorted(map(tuple, pieces.select("k", "i").collect())) == [(1, i) for i in range(10)] + [(2, i) for i in range(3)]


def test_targets_of_many_sources(spark):
    rng = random.Random(8)
    sizes = {f"s{k:04}": rng.choice([0, 1, 5, 100, 10_000]) for k in range(500)} | {None: 77}
    sized = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long").repartition(7)
    want = plain_targets(sizes)
    got = {r["source"]: r["target"] for r in mixing.targets(sized).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * max(1, want[k]) for k in want)


def test_pivot_keeps_words_and_expectations():
    rng = np.random.default_rng(6)
    size = rng.integers(1, 50, 40)
    rounds = []
    for k in range(400):
        p = np.full(40, 0.3)
        done, held = mixing.pivot(size, p, (k,))
        left = p[held] * size[held] if held >= 0 else 0
        assert abs((done * size).sum() + left - 0.3 * size.sum()) < 1e-6
        rounds.append(done)
    assert abs(np.mean(rounds) - 0.3) < 0.02


def test_readings():
    words = ["idiot", "trash", "stupid", "loser", "moron", "worthless"] * 9 + ["the", "and", "of", "there", "other", "hello", "table"] * 20
    cells, n = toxicity.letter_counts([" ".join(words)], [0])
    counts = np.zeros(toxicity.SIZE**3)
    counts[cells] = n
    costs = toxicity.trigram_costs(counts)
    scorer = toxicity.Model(costs, {f"{w}|": 5.0 for w in ("idiot", "trash", "stupid", "loser", "moron")}, np.array([-4, 2, 0, 0, 2, 0, 0.0])).scorer()
    for t in ("idiot", "IDIOT!!", "1d10t", "tr@sh", "tra$h", "stup1d", "$tupid", "l.o.s.e.r", "l-o-s-e-r", "mmmoron", "m0r0n", "sttuupid"):
        assert scorer[t.lower()] == 5.0, t
    for t in ("the", "table", "", "!!!", "12345", "x" * 5000):
        assert scorer[t] == 0.0, t
    assert scorer.hits("so i d i o t and m o r o n")[1] == pytest.approx(np.log(3))
    for t in ("you are a s t u p i d one", "I l o s e r", "y o u m o r o n, there", "a b c i d i o t"):
        assert scorer.hits(t)[1] == pytest.approx(np.log(2)), t
    assert scorer.hits("a " * 300_000)[1] == 0
    assert scorer.score(None) == scorer.score("") == scorer.score("hello there") < 0.1 < scorer.score("1d10t tr@sh")


def test_decode_against_search():
    rng = np.random.default_rng(8)
    costs = rng.random((toxicity.SIZE,) * 3).astype(np.float32) * 3

    def search(options, a, b):
        if not options:
            return float(costs[a, b, 0])
        return min((p + search(options[1:], b, toxicity.code(x)) + float(costs[a, b, toxicity.code(x)]) if x else p + search(options[1:], a, b)) for x, p in options[0])

    def cost(options, text):
        """The least cost of a reading with this text."""
        if not options:
            return {((0, 0), ""): 0.0}.get(((0, 0), text), np.inf)

        def go(i, j, a, b):
            if i == len(options):
                return float(costs[a, b, 0]) if j == len(text) else np.inf
            best = np.inf
            for x, p in options[i]:
                if not x:
                    best = min(best, p + go(i + 1, j, a, b))
                elif j < len(text) and text[j] == x:
                    best = min(best, p + float(costs[a, b, toxicity.code(x)]) + go(i + 1, j + 1, b, toxicity.code(x)))
            return best

        return go(0, 0, 0, 0)

    for t in ("1d10t", "aab", "l.o!", "$$x", "b*d", "4@"):
        options = toxicity.readings(t)
        assert cost(options, toxicity.decode(t, costs)) == pytest.approx(search(options, 0, 0), rel=1e-5), t


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(5)
    plain = ["table", "river", "stone", "cloud", "paper", "green", "walking", "slowly", "under", "window"]
    bad = ["idiot", "moron", "loser"]
    disguised = ["1diot", "m0ron", "l0ser", "i.d.i.o.t", "moooron", "l o s e r"]
    rows = []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(30)]
        y = i % 3 == 0
        if y:
            for _ in range(4):
                w.insert(rng.randrange(30), rng.choice(disguised if i % 2 else bad))
        rows.append((i, " ".join(w), int(y)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.withColumns({"score": F.lit("x"), "predicted": F.lit(1), "lang": F.lit("en")}).drop("toxic"), df.select("doc_id", "toxic")


def test_held_out_accuracy(spark, toxic_docs):
    docs, labels = toxic_docs
    out = toxicity.score_held_out(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(out) > 150 and all((r["predicted"] == 1) == (r["score"] >= 0.7) for r in out)
    assert sum(r["predicted"] == r["toxic"] for r in out) >= 0.98 * len(out)


def test_scores_against_plain_lookup(spark, toxic_docs):
    """Scores without the shortcut over heads and without a cache: every token's readings, every feature of theirs."""
    docs, labels = toxic_docs
    model = toxicity.fit(docs, labels)
    rng = random.Random(12)
    pieces = ["1diot", "m0ron", "l o s e r", "moooron", "id!ot", "idiots", "table", "I", "a", "l", "o", "s", "x1", "lo$er", "RIVER,", "--", "é", "midiot", "ido", "mor0n."]
    for _ in range(300):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        tokens = text.lower().split()
        weights = {}
        for t in [*tokens, *toxicity.spaced(tokens)]:
            readings = [toxicity.edges_off(t)] if toxicity.plain(toxicity.edges_off(t)) and not any(c in toxicity.LEET for c in t) else [toxicity.edges_off(t) if toxicity.edges_off(t).isalpha() else "", toxicity.decode(t, model.costs)]
            weights[t] = max((model.lexicon.get(f, 0.0) for r in readings if r for f in (r + "|", *(r[:k] for k in range(4, 10) if k <= len(r)))), default=0.0)
        hits = [(weights[t], t) for t in [*tokens, *toxicity.spaced(tokens)] if weights[t]]
        n = len(hits)
        x = [1.0, np.log1p(n), np.log1p(len({t for _, t in hits})), np.log1p(sum(w for w, _ in hits)), n >= 2, n >= 3, np.log1p(n) * np.log1p(len(tokens)) / 6]
        z = sum(a * b for a, b in zip(x, model.weights, strict=True))
        assert model.scorer().score(text) == pytest.approx(1 / (1 + np.exp(-max(-30, min(30, z))))), text


def test_toxicity_edges(spark, toxic_docs):
    docs, labels = toxic_docs
    model = toxicity.fit(docs, labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int")))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "idiot moron loser idiot"), (2, "x" * 100_000 + " 1" * 50_000)], "doc_id long, text string")
    rows = toxicity.score(odd, model).collect()
    assert [r["predicted"] for r in rows] == [0, 0, 1, 0] and rows[0]["score"] == rows[1]["score"] and rows[0]["held_out"] is False
    assert toxicity.keep_clean(odd, model).count() == 3 and toxicity.score(odd.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs, nothing).collect()} == {0}


def test_toxicity_learns_from_all_labels(spark):
    """A word that only rows with the greatest hashes of ids have, past the 20,000 least."""
    rows = spark.range(24_000).withColumn("place", F.row_number().over(Window.orderBy(F.xxhash64("id"))))
    rows = rows.withColumn("toxic", (F.col("place") > 23_900).cast("int")).withColumn("text", F.when(F.col("toxic") == 1, "you old blackguard").otherwise("a river of stone"))
    docs, labels = rows.select(F.col("id").alias("doc_id"), "text").cache(), rows.select(F.col("id").alias("doc_id"), "toxic").cache()
    model = toxicity.fit(docs, labels)
    assert "blackguard|" in model.lexicon and model.scorer().score("a blackguard") > 0.1 > 0.001 > model.scorer().score("a river")
    x = np.array([model.scorer().hits(r["text"]) for r in docs.orderBy("doc_id").collect()])
    y = np.array([r["toxic"] for r in labels.orderBy("doc_id").collect()])
    slope = x.T @ (y - 1 / (1 + np.exp(-(x @ model.weights)))) - np.r_[1e-3, np.ones(6)] * model.weights
    assert np.abs(slope).max() < 1e-4
    shuffled = toxicity.fit(docs.repartition(7), labels, few=0)
    assert shuffled.lexicon == model.lexicon and np.array_equal(shuffled.weights, model.weights)


def test_toxicity_reads_few_texts_at_once(spark, toxic_docs):
    """Scores of a batch of 10,000 rows come 512 rows at a time, whatever the session's batches."""
    docs, labels = toxic_docs
    model, seen = toxicity.fit(docs, labels), []

    class Narrow:
        """Stands for a DataFrame: keeps the function that its rows would go through."""

        schema = spark.createDataFrame([], "doc_id long, text string, held_out boolean").schema

        def __getitem__(self, name):
            return F.col(name)

        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10_000)), "text": ["you idiot moron", None] * 5000, "held_out": [False] * 10_000})
            seen.extend(function(iter([batch])))

    toxicity.score(Narrow(), model)
    assert max(b.num_rows for b in seen) == 512 and [i for b in seen for i in b.column(0).to_pylist()] == list(range(10_000))


def tokens_of(t):
    return re.findall("[a-z0-9\u0080-\U0010ffff]+", t.lower())


def test_tokens():
    rng = random.Random(3)
    texts = ["", "Hello, World hello", "é É a1 b-2", " x", "x ", "abc", "ABC abc", "a" * 5000 + " b"] + ["".join(rng.choice("ab Aé,. 1") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    data = [decontamination.folded(t) for t in texts]
    t, first = decontamination.tokens(b"".join(data), np.cumsum([0] + [len(d) for d in data]))
    known = {}
    for k, text in enumerate(texts):
        own, words = t[first[k] : first[k + 1]], tokens_of(text)
        assert len(own) == len(words)
        assert all(known.setdefault(w, h) == h for w, h in zip(words, own, strict=True))
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("n", range(1, 17))
def test_masks_miss_no_window(n):
    """Each window of n tokens with a quarter of them substituted, at any places, is hit."""
    masks = decontamination.masks_of(n)
    for gone in itertools.combinations(range(n), n // 4):
        assert any(all(m[k] == "0" or at + k not in gone for k in range(len(m))) for m in masks for at in range(n - len(m) + 1)), gone


def plain_overlaps(docs, items, min_tokens=12, share=0.75):
    """Every document, item and diagonal, every stretch."""
    out = set()
    for d, text in docs:
        t = tokens_of(text or "")
        for item, item_text in items:
            own, best = tokens_of(item_text or ""), None
            for shift in range(-len(own) + 1, len(t)) if item is not None else ():
                lo, hi = max(0, -shift), min(len(own), len(t) - shift)
                same = [own[k] == t[k + shift] for k in range(lo, hi)]
                for s in range(len(same)):
                    for e in range(s + max(1, min(min_tokens, len(own))), len(same) + 1):
                        if same[s] and same[e - 1] and sum(same[s:e]) >= share * (e - s):
                            row = (-(e - s), e - s - sum(same[s:e]), lo + s + shift, lo + s)
                            best = min(best or row, row)
            if best:
                out.add((d, item, best[2], best[3], -best[0], best[1]))
    return out


def test_decontamination(spark, make):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([*range(1, 20), 30, 40])]
    items += [(30, "a " * 30), (31, "a b " * 9), (32, None), (33, ""), (None, " ".join(text(30))), (3, " ".join(text(25))), (34, items[20][1])]
    docs = []
    for d in range(90):
        w = text(rng.choice([0, 5, 40]))
        p = tokens_of(rng.choice(items)[1] or "")
        for k in rng.sample(range(len(p)), rng.randint(0, len(p) // 4)):
            p[k] = "changed"
        at = rng.randint(0, len(w))
        w[at:at] = p
        docs.append((d % 80 if d % 9 else None, " ".join(w).upper() if d % 2 else ", ".join(w)))
    docs += [(200, ""), (201, None), (202, "a " * 60), (203, "b a " * 20), (204, "A, a; b"), docs[0], docs[1]]
    df, bench = make(docs), spark.createDataFrame(items, "item_id long, text string")
    want = plain_overlaps(docs, items)
    dirty = {t for d, t in docs if any(x[0] == d for x in plain_overlaps([(d, t)], items))}
    for limit in (1 << 20, 0):
        got = {tuple(r) for r in decontamination.overlaps(df, bench, limit=limit).collect()}
        rows = {}
        for d, t in docs:
            rows.setdefault(d, set()).update(plain_overlaps([(d, t)], items))
        assert len(got & want) >= 0.99 * len(want) and all(x in rows[x[0]] for x in got)
        kept = decontamination.keep_clean(df, bench, limit=limit)
        assert kept.columns == df.columns
        left = [r["text"] for r in kept.collect()]
        assert sorted(map(str, left)) == sorted(str(t) for _, t in docs if t not in dirty)
        assert decontamination.overlaps(df, bench.limit(0), limit=limit).count() == 0 and decontamination.overlaps(df.limit(0), bench, limit=limit).count() == 0
        assert decontamination.keep_clean(df, bench.limit(0), limit=limit).count() == len(docs)


def test_recall_of_substituted_passages():
    """Passages at the stated minimum and above, substituted at random places, are found."""
    rng = random.Random(9)
    for n in (12, 16, 20, 30, 60):
        own = [f"t{i}" for i in range(n)]
        bench = decontamination.Benchmark([(1, decontamination.item_tokens(" ".join(own)))])
        texts = []
        for _ in range(400):
            p = list(own)
            for k in rng.sample(range(1, n - 1), n // 4):
                p[k] = "x"
            texts.append(" ".join([*(f"q{k}" for k in range(rng.randint(0, 30))), *p, "z"]))
        assert len(list(decontamination.matched(bench, texts, 12, 0.75))) == 400, n


def test_repeated_tokens_take_no_square():
    bench = decontamination.Benchmark([(1, decontamination.item_tokens("a " * 800)), (2, decontamination.item_tokens("a b " * 400))])
    began = time.perf_counter()
    ((_, found),) = decontamination.matched(bench, ["a " * 200_000], 12, 0.75)
    assert found[0] == (0, 0, 800, 0) and time.perf_counter() - began < 10


def pieces(t):
    return [*re.findall(r"\w+|[^\w\s]+", (t or "").lower()), "\0\0"]


def plain_losses(texts, vocabulary, words_prior=30.0, pairs_prior=2.0):
    """The mean loss of a document's tokens under counts of ``texts``, without the document's own where it is one of them."""
    words, pairs = Counter(), Counter()
    for t in texts:
        words.update(pieces(t))
        pairs.update(zip(["\0\0", *pieces(t)], pieces(t), strict=False))

    def loss(text, out):
        found = pieces(text)
        own, own_pairs = (Counter(found), Counter(zip(["\0\0", *found], found, strict=False))) if out else (Counter(), Counter())
        n, total = sum(words.values()) - sum(own.values()), 0.0
        for v, w in zip(["\0\0", *found], found, strict=False):
            one = (words[w] - own[w] + words_prior / vocabulary) / (n + words_prior)
            total -= np.log((pairs[v, w] - own_pairs[v, w] + pairs_prior * one) / (words[v] - own[v] + pairs_prior))
        return total / len(found)

    return loss


@pytest.mark.parametrize("chunk", [1, 60, lm_scoring.CHUNK])
def test_model_scoring(spark, make, chunk):
    texts = ["abab ab", "ab! ab ab", "zz9 Zz zz, !?", "", None, "é€ zz\tab", "q" * 3000, (None, "ab zz"), (None, "ab zz"), (2, "zz9"), "ab zz zz zz ab zz", "the ab zz ab"]
    df = make(texts).repartition(3)
    target = spark.createDataFrame([(0,), (1,), (1,), (None,), (99,)], "doc_id long")
    got = lm_scoring.cross_entropy_difference(df, target, chunk_bytes=chunk, priors=(30.0, 2.0)).collect()
    plain = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    vocabulary = len({w for _, t in plain for w in pieces(t)})
    near, far = plain_losses([t for i, t in plain if i in (0, 1)], vocabulary), plain_losses([t for _, t in plain], vocabulary)
    want = [(i, len(pieces(t)), near(t, i in (0, 1)) - far(t, True)) for i, t in plain]
    for side in (got, want):
        side.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    for r, w in zip(got, want, strict=True):
        assert tuple(r)[:2] == w[:2] and r["ce_diff"] == pytest.approx(w[2], abs=1e-6)
    assert lm_scoring.cross_entropy_difference(df.limit(0), target).count() == 0
    assert lm_scoring.cross_entropy_difference(df, target.limit(0)).count() == len(texts)


def test_chunks_do_not_change_scores(make, spark):
    rng = random.Random(2)
    df = make([" ".join(rng.choice(["one", "two", "three", "four", f"w{i}"]) for _ in range(20)) for i in range(80)])
    target = spark.range(0, 80, 4).withColumnRenamed("id", "doc_id")
    scores = [sorted(map(tuple, lm_scoring.cross_entropy_difference(df.repartition(n), target, chunk_bytes=size).collect())) for n, size in ((1, 1 << 20), (3, 100), (5, 1))]
    assert scores[0] == scores[1] == scores[2]


def test_copies_and_order_are_known(make, spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(60)]
    shuffled = " ".join(sorted(texts[0].split()))
    df = make([*texts, texts[1], shuffled])
    by = {r["doc_id"]: r["ce_diff"] for r in lm_scoring.cross_entropy_difference(df, spark.range(2, 20).withColumnRenamed("id", "doc_id")).collect()}
    assert min(by[1], by[60]) > max(v for k, v in by.items() if k not in (1, 60))  # the background knows a copy
    assert by[0] != by[61]  # the same words in another order


def test_packed():
    x = np.array([0, 5, 5, 1 << 40, 3], np.int64)
    assert np.array_equal(lm_scoring.unpacked(lm_scoring.packed(x)), x)
    k = np.sort(np.random.default_rng(1).integers(0, 1 << 56, 1000, np.uint64))
    assert np.array_equal(lm_scoring.unpacked_keys(lm_scoring.packed_keys(k)), k)
    assert not len(lm_scoring.unpacked(lm_scoring.packed(x[:0])))
    at = lm_scoring.cut(k, 7)
    assert at[0] == 0 and at[-1] == len(k) and all(int(v) * 7 >> 56 == j for j in range(7) for v in k[at[j] : at[j + 1]])
