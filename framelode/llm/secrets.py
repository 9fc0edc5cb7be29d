"""Secrets in text: fixed patterns plus guess-cost analysis of values in a credential context.

Base kinds, in order: ``assign access hex``. Added kind: ``guess``, a value that follows a
credential cue and whose cheapest segmentation into words, dates, repeats, keyboard walks
and brute-force spans still needs at least ``10 ** min_guesses`` guesses. After blanks or
``is``, values of letters alone count as prose.

A null or empty text has no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from math import inf, log10

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("assign", "access", "hex")
RANK = {k: i for i, k in enumerate((*BASE, "guess"))}
MIN_GUESSES, MOST = 10.0, 40.0

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

# Keywords of the base pattern, then wider credential cues.
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
CUES = (
    "password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey", "api-key",
    "access_key", "private_key", "credential", "authorization", "bearer", "auth",
)
VALUE = re.compile(r"""s?["']?(?:\x20*[:=]\x20*|\x20+is\x20+|\x20+)["']?(?:[Bb]earer\x20+)?(?=[!-&(-~])""")
RUN = re.compile(r"[!-&(-~]*")
SIGNED = re.compile(r"[A-Za-z]*[^A-Za-z]")

# Words that passwords are made of, the commonest first.
WORDS = (
    "password", "admin", "welcome", "login", "letmein", "monkey", "dragon", "master", "secret", "hello", "summer",
    "winter", "spring", "autumn", "love", "princess", "sunshine", "football", "baseball", "shadow", "superman",
    "batman", "trustno", "access", "flower", "hunter", "killer", "soccer", "hockey", "ranger", "jordan", "michael",
    "charlie", "thomas", "robert", "daniel", "andrew", "joshua", "jessica", "ashley", "nicole", "root", "user",
    "guest", "test", "demo", "example", "sample", "changeme", "default", "temp", "pass", "word", "key", "token",
    "server", "system", "service", "database", "oracle", "mysql", "public", "private", "company", "office", "home",
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november",
    "december", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "black", "white",
    "green", "blue", "orange", "silver", "golden", "purple", "yellow", "happy", "lucky", "angel", "star", "cookie",
    "cheese", "coffee", "chocolate", "banana", "apple", "pepper", "ginger", "tiger", "eagle", "lion", "wolf",
    "the", "and", "for", "you", "that", "this", "with", "have", "from", "not", "are", "was", "correct", "horse",
    "battery", "staple", "magic", "music", "money", "power", "freedom", "forever", "computer", "internet",
)
WALKS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm", "qazwsxedcrfvtgbyhnujm")
LEET = str.maketrans("013457@$!", "oieastasi")
DATE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12][0-9]|3[01]))?)?|(?:0[1-9]|[12][0-9]|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?[0-9]{2}")

SWITCH = 0.6  # log10 cost of starting one more segment
RANKS = {w: log10(k + 2) for k, w in enumerate(WORDS)}
LONGEST = max(map(len, WORDS))
STEPS = np.zeros((128, 128), bool)  # neighbours on a keyboard walk
for _w in WALKS:
    for _a, _b in zip(_w, _w[1:], strict=False):
        STEPS[ord(_a), ord(_b)] = STEPS[ord(_b), ord(_a)] = True


def brute_cost(c: str) -> float:
    """log10 of the alphabet that a brute-force attacker tries for this character."""
    return 1.0 if c.isdigit() else log10(26) if c.islower() or c.isupper() else log10(33) if c < "\x7f" else 3.0


def reaches(same: np.ndarray) -> np.ndarray:
    """For each place of ``same`` the first one from there on that is not set."""
    n = len(same)
    stops = np.where(same, n, np.arange(n))
    return np.minimum.accumulate(stops[::-1])[::-1]


def guess_cost(value: str, most: float = inf) -> tuple[float, list[tuple[str, str]]]:
    """log10 of the guesses of the cheapest segmentation, and its segments ``(kind, text)``.

    Dynamic programming over prefixes, the cheapest first: from each position the words (up to the longest one) and
    dates that start there, the whole keyboard walk and the whole repeat that start there, and one brute-force
    character, which is free of the switching cost when it goes on with a brute-force span. Ties go to the least
    position. Where every way costs ``most`` or more, the cost is ``most`` and there are no segments: the program ends
    with the prefixes that cost less, so a long value takes no longer than a short one.
    """
    n = len(value)
    if not n:
        return 0.0, []
    low, plain = value.lower(), value.lower().translate(LEET)
    if len(low) != n:
        low = plain = value
    code = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.minimum(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), 127)
    walk_end = reaches(STEPS[small[:-1], small[1:]])
    repeat_end = [reaches(code[:-u] == code[u:]) for u in range(1, 5)]
    done: dict[tuple[int, bool], tuple[tuple[int, bool], str]] = {}
    open_: list[tuple[float, int, bool, tuple[int, bool], str]] = [(0.0, 0, False, (0, False), "")]
    while open_:
        cost, i, brute, before, kind = heappop(open_)
        if cost >= most:
            break
        if (i, brute) in done:
            continue
        here = i, brute
        done[here] = before, kind
        if i == n:
            segments = []
            while here[0]:
                before, kind = done[here]
                if kind == "brute" and segments and segments[-1][0] == "brute" and goes_on:
                    segments[-1] = kind, value[before[0]] + segments[-1][1]
                else:
                    segments.append((kind, value[before[0] : here[0]]))
                goes_on = before[1]
                here = before
            return cost, segments[::-1]
        step = brute_cost(value[i])
        heappush(open_, (cost + step + SWITCH * (not brute), i + 1, True, here, "brute"))
        new = cost + SWITCH
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            if (w := low[i:j]) in RANKS or (w := plain[i:j]) in RANKS:
                extra = 0.3 * (low[i:j] != w) + 0.3 * (value[i:j] != low[i:j])
                heappush(open_, (new + RANKS[w] + extra, j, False, here, "word"))
        if m := DATE.match(value, i):
            for j in {m.end(), i + 4} if m.group()[:2] in ("19", "20") else {m.end()}:
                heappush(open_, (new + (2.1 if j - i <= 4 else 4.3), j, False, here, "date"))
        if i + 1 < n and (j := int(walk_end[i]) + 1) - i >= 3:
            heappush(open_, (new + log10(40) + log10(j - i), j, False, here, "walk"))
        for u in range(1, 5):
            if i + u < n and (j := int(repeat_end[u - 1][i]) + u) - i >= max(3, 2 * u):
                heappush(open_, (new + sum(brute_cost(c) for c in value[i : i + u]) + log10((j - i) / u + 1), j, False, here, "repeat"))
    return most, []


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in sorted({*KEYWORDS, *CUES}):
        a.add_word(w, (len(w), w in KEYWORDS, w in CUES))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """ASCII letters in lower case, every code point where it was."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate({c: c + 32 for c in range(65, 91)})


def find(text: str | None, cues: ahocorasick.Automaton, min_guesses: float = MIN_GUESSES, most: float = MOST) -> tuple[list[tuple[int, int, str]], float | None]:
    """All spans ``(start, end, kind)`` of a text, by start, then kind, and the greatest cost of a ``guess`` (at most ``most``).

    A value ends with its run of printable characters, or where the next cue with a sign of its own starts: so cues that
    follow each other without blanks share no characters, and a text's values are no longer than the text."""
    if not text:
        return [], None
    out, done = [], 0
    hits = sorted((last - n + 1, -n, key, cue) for last, (n, key, cue) in cues.iter(lowered(text)))
    values: dict[tuple[int, int], None] = {}
    told, run_end = [], 0  # (start of the cue, start of its value, whether a sign is between)
    for start, n, key, cue in hits:
        if key and start >= done and (m := ASSIGN.match(text, start)):
            done = m.end()
            values[m.span(2)] = None
            if m.end(2) - m.start(2) >= 8:
                out.append((start, done, "assign"))
        if cue and (m := VALUE.match(text, start - n)):
            told.append((start, m.end(), any(c in ":=" for c in m.group())))
    signs = np.array([start for start, _, sign in told if sign])
    nexts = np.searchsorted(signs, [s for _, s, _ in told])  # the first cue with a sign from a value's start on
    for (_, s, sign), k in zip(told, nexts, strict=True):
        if run_end <= s:
            run_end = RUN.match(text, s).end()
        e = min(run_end, int(signs[k])) if k < len(signs) else run_end
        while e > s and text[e - 1] in ",.;:)]}\"'":
            e -= 1
        if e > s and (sign or SIGNED.match(text, s, e)):  # plain words after a cue and blanks or ``is`` are prose
            values[s, e] = None
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    costs = {v: guess_cost(text[v[0] : v[1]], most)[0] for v in values if v[1] - v[0] >= 6}
    costs = {v: c for v, c in costs.items() if c >= min_guesses}
    out += [(s, e, "guess") for s, e in costs]
    return sorted(out, key=lambda s: (s[0], RANK[s[2]], s[1])), max(costs.values(), default=None)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_guesses: float = MIN_GUESSES) -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, base_sha256, spans, n_guess, max_guesses`` for each row.

    ``max_guesses``: log10 of the guesses of the costliest reported value, ``MOST`` at most, null without one. An id
    column of a result's name takes that name's place twice: rename it before.
    One narrow pass: no shuffle, memory bounded by an Arrow batch. Ids may be null or repeated;
    other columns are not read.
    """
    narrow = df.select(df[id_col], df[text_col])
    kind = narrow.schema[0].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cues = automaton()
        for b in batches:
            counts: dict[str, list[int]] = {k: [] for k in RANK}
            sha, spans, most = [], [], []
            for text in b.column(1).to_pylist():
                found, cost = find(text, cues, min_guesses)
                for k, c in counts.items():
                    c.append(sum(s[2] == k for s in found))
                sha.append(hashlib.sha256(joined([s for s in found if s[2] in BASE]).encode()).hexdigest())
                spans.append(joined(found))
                most.append(cost and round(cost, 6))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(counts["guess"], pa.int64()), pa.array(most, pa.float64())],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_guesses"],
            )

    return narrow.mapInArrow(scan, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_guesses double")
