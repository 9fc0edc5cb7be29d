"""Fingerprints, the Gray-order index, components and the filter, against brute force."""

import re

import numpy as np
import pytest
import xxhash

from framelode.llm import simhash


def plain_fingerprint(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(fp, group, radius=4):
    label = np.arange(len(fp))
    for i in range(len(fp)):
        j = np.flatnonzero((np.bitwise_count(fp ^ fp[i]) <= radius) & (group == group[i]))
        label = simhash.shrink(label, np.full(len(j), i), j)
    return label


@pytest.mark.parametrize("t", ["", None, "a", "A b", "x  y\tz\x0bq", "É ñ a b c d e", "  ", "a b c d e f g " * 50, "the cat \x1c sat on\u00a0mat"])
def test_fingerprint(t):
    assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_gray_rank():
    n = np.arange(256, dtype=np.uint64)
    assert np.array_equal(simhash.gray_rank(n ^ (n >> np.uint64(1))), n)


@pytest.mark.parametrize("seed", range(25))
def test_index(seed, monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    rng = np.random.default_rng(seed)
    centers = rng.integers(0, 2**63, rng.integers(1, 6)).astype(np.uint64)
    fp = centers[rng.integers(0, len(centers), rng.integers(1, 300))]
    for _ in range(rng.integers(1, 9)):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64))
    group = np.sort(rng.integers(0, rng.integers(1, 8), len(fp)))
    order = np.lexsort((simhash.gray_rank(fp), group))
    fp = fp[order]
    assert np.array_equal(simhash.GrayIndex(fp, group).connected(4), brute(fp, group))


def test_blocks_cover_every_link():
    rng, masks = np.random.default_rng(5), simhash.block_keys(4)
    for _ in range(500):
        diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(diff & m == 0 for m in masks)


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 500, n)]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(9)
    out = ["", None, " \t", "short", "short"]
    for _ in range(12):
        w = words(rng, 200)
        out.append(" ".join(w))
        for _ in range(8):
            e = list(w)
            e[rng.integers(0, 200)] = "edit"
            out += [" ".join(e)] * 2
    return out + ["x " * 50_000]


def test_components(make, texts):
    df = make(texts)
    fp = np.array([plain_fingerprint(t) for t in texts], np.uint64)
    want = brute(fp, np.zeros(len(fp)))
    for hot in (1 << 15, 4):
        got = simhash.near_duplicates(df, hot=hot).orderBy("doc_id").collect()
        assert [int(r["fingerprint"], 16) for r in got] == fp.tolist()
        assert [r["component_id"] for r in got] == want.tolist()
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_are_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 199), (199, 201)], "a long, b long")
    assert {r["fp"]: r["root"] for r in simhash.components(edges).collect()} == {i: 0 for i in range(1, 61)} | {200: 199, 201: 199}


def test_one_of_each(make, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "short"), (None, "short"), (None, None), (500, "alone here"), (500, "alone here"), (500, "other words there entirely")]
    df = make(rows)
    fp = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    roots = brute(fp, np.zeros(len(fp)))
    groups = {}
    for (i, t), r in zip(rows, roots, strict=True):
        groups.setdefault(r, []).append(i if i is not None else float("inf"))
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(min(g) for g in groups.values())
