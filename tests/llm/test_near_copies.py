"""Near copies against a comparison of all pairs of shingle sets."""

import random

import numpy as np
import pytest

from framelode.llm import near_copies, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(texts):
    sets, label = [plain_set(t) for t in texts], np.arange(len(texts))
    for i, a in enumerate(sets):
        near = [j for j in range(i) if (not a and not sets[j]) or len(a & sets[j]) * 5 >= 4 * len(a | sets[j]) > 0]
        label = simhash.shrink(label, np.full(len(near), i), np.array(near, int))
    return label


def edited(rng, text, n):
    words = text.split()
    for k in rng.sample(range(len(words)), n):
        words[k] = f"edit{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def family():
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    out = ["", None, "  ", "one two", "ONE  two", "one two three"]
    for _ in range(30):
        base = text(rng.randint(5, 300))
        out += [base, *(edited(rng, base, min(len(base.split()), rng.randint(0, 12))) for _ in range(3))]
    hub = text(200)
    out += [hub, *(edited(rng, hub, rng.randint(1, 5)) for _ in range(40))]
    return out


@pytest.mark.parametrize("hot", [near_copies.HOT, 7])
def test_all_pairs(make, family, hot):
    want = sorted({int(k) for k in brute(family)})
    assert 30 < len(want) < len(family) - 40
    got = near_copies.one_of_each(make(family), hot=hot)
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert near_copies.one_of_each(make(family).limit(0)).count() == 0


def test_threshold_is_met_exactly():
    a = np.arange(9, dtype=np.uint64)
    assert near_copies.connected([a[:8], a[:9], a[1:9]]).tolist() == [0, 0, 0]
    assert near_copies.connected([np.arange(10, dtype=np.uint64), np.arange(2, 10, dtype=np.uint64)]).tolist() == [0, 0]
    assert near_copies.connected([np.arange(10, dtype=np.uint64), np.arange(3, 10, dtype=np.uint64)]).tolist() == [0, 1]


def test_stage_drops_an_edited_copy(spark, make):
    rng = random.Random(11)
    texts = [" ".join(f"word{rng.randrange(500)}x" for _ in range(60)) for _ in range(20)]
    words = texts[2].split()
    words[7] = "edited"  # 51 of 61 shingles are shared
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, make([*texts, " ".join(words)], extra=False), "")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(20))


def test_links_that_only_the_gray_index_finds(spark, make):
    """Texts and themselves without two words, at exactly 0.8, that share no band and are within 4 bits; null and empty texts are one group."""
    texts = [
        "w264 w128 w78 w367 w40 w123 w176 w347 w382 w203 w248 w143 w351 w92",
        "w178 w41 w3 w189 w216 w116 w268 w188 w66 w198 w135 w128 w161 w22",
        "w280 w209 w359 w158 w98 w208 w110 w325 w247 w272 w285 w199 w128 w3",
    ]
    cut = [t.rsplit(" ", 2)[0] for t in texts]
    for a, b in zip(texts, cut, strict=True):
        x, y = near_copies.shingles(a), near_copies.shingles(b)
        assert not {*zip(range(24), near_copies.bands(x), strict=True)} & {*zip(range(24), near_copies.bands(y), strict=True)}
        assert (simhash.print_of(x) ^ simhash.print_of(y)).bit_count() <= simhash.RADIUS and near_copies.connected([x, y]).tolist() == [0, 0]
    lines = [*texts, *cut, "", None]
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, make(lines, extra=False), "")
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 1, 2, 6] == sorted({int(k) for k in brute(lines)})


def test_a_close_fingerprint_alone_is_no_link(make):
    """Within the radius, yet under 0.8: the check on the whole sets holds the index's candidates too."""
    rng = random.Random(3)
    while True:
        words = [f"w{rng.randrange(400)}" for _ in range(14)]
        a, b = " ".join(words), " ".join(words[:-3])
        x, y = near_copies.shingles(a), near_copies.shingles(b)
        if (simhash.print_of(x) ^ simhash.print_of(y)).bit_count() <= simhash.RADIUS:
            break
    assert len(np.intersect1d(x, y)) * 10 == len(np.union1d(x, y)) * 7
    assert near_copies.one_of_each(make([a, b])).count() == 2


def test_buckets_of_the_index_meet_again_after_chunks(make):
    """In chunks of one set each, so that links are found when chunks meet, and only there."""
    texts = [
        "w264 w128 w78 w367 w40 w123 w176 w347 w382 w203 w248 w143 w351 w92",
        "w178 w41 w3 w189 w216 w116 w268 w188 w66 w198 w135 w128 w161 w22",
        "w280 w209 w359 w158 w98 w208 w110 w325 w247 w272 w285 w199 w128 w3",
    ]
    lines = [*texts, *(t.rsplit(" ", 2)[0] for t in texts)]
    assert sorted(r["doc_id"] for r in near_copies.one_of_each(make(lines), hot=1).collect()) == [0, 1, 2]
