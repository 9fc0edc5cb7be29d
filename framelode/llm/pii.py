"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes and
identifier cues, in either case) in one pass over the text. A deterministic parser for each
anchor expands it to its boundaries and validates it: a cue starts a word, and what
follows it has the form and the checks of its kind (``ACCOUNTS``).

Kinds, in order: ``email ip card phone`` (the base) and ``url iban account`` (added).
A null or empty text has no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from framelode.llm.secrets import lowered

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account")
RANK = {k: i for i, k in enumerate(BASE + ADDED)}

# Schemes and identifier cues that anchor the added kinds.
SCHEMES = ("http://", "https://", "ftp://", "sftp://")
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "customer id", "passport", "ssn", "social security", "tax id", "routing")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBER_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
PHONE_RUN = re.compile(r"[0-9][ ().0-9-]*")
URL_REST = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
IBAN_BODY = re.compile(r"[ :=#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)")
IBAN_SHORTER = re.compile(r"(?: ?[A-Z0-9]{4}| ?[A-Z0-9]{1,3})\Z")
TO_NUMBER = re.compile(r"(?i:(?: number| numbers| no\.?| nr\.?| num\.?| is)?(?: is)?)[ :=#]{1,3}")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
SSN = re.compile(r"([0-9]{3})([ -]?)([0-9]{2})\2([0-9]{4})(?![ -]?[0-9])")
CALENDAR = re.compile(r"(?:(?:19|20)[0-9]{2}([ -]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|(?:0[1-9]|[12][0-9]|3[01])([ -])(?:0[1-9]|1[0-2])\2(?:19|20)[0-9]{2})(?![0-9])")


def ssn(body: str) -> bool:
    """Area, group and serial are numbers that are given out."""
    m = SSN.fullmatch(body)
    return bool(m) and m.group(1) not in ("000", "666") and m.group(1) < "900" and m.group(3) != "00" and m.group(4) != "0000"


def routing(body: str) -> bool:
    """Nine digits in one piece, with the weighted sum (3, 7, 1) of a bank's routing number."""
    return len(body) == 9 and body.isdigit() and body != "0" * 9 and sum(w * int(c) for w, c in zip((3, 7, 1) * 3, body, strict=True)) % 10 == 0


def account(body: str) -> bool:
    """6 to 17 digits, not all the same, that do not start as a date."""
    number = body.replace(" ", "").replace("-", "")
    return 6 <= len(number) <= 17 and len(set(number)) > 1 and not CALENDAR.match(body)


def tax_id(body: str) -> bool:
    return account(body) and 8 <= len(body.replace(" ", "").replace("-", "")) <= 12


#: The check of the number after each cue.
ACCOUNTS = {"ssn": ssn, "social security": ssn, "routing": routing, "tax id": tax_id}


def automaton() -> ahocorasick.Automaton:
    """Anchors, in lower case, to (parser, length)."""
    a = ahocorasick.Automaton()
    for w in "@":
        a.add_word(w, ("email", 1))
    a.add_word("+", ("phone", 1))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for kind, words in (("url", SCHEMES), ("iban", IBAN_CUES), ("account", ACCOUNT_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_at(text: str, at: int) -> tuple[int, int] | None:
    """The longest run of groups after the cue that has the check digits."""
    if m := IBAN_BODY.match(text, at):
        body = m.group(1)
        while body and len(body.replace(" ", "")) >= 12:
            if mod97(body):
                return m.start(1), m.start(1) + len(body)
            body = IBAN_SHORTER.sub("", body)
    return None


def account_at(text: str, at: int, cue: str) -> tuple[int, int] | None:
    """The number after the cue, to its last digit, if it passes the cue's check."""
    if (m := TO_NUMBER.match(text, at)) and (body := CHAIN.match(text, m.end())) and ACCOUNTS.get(cue, account)(body.group()):
        return body.span()
    return None


def find(text: str | None, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` of a text, by start, then kind."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = []
    email_end = ip_end = card_end = phone_end = url_end = 0
    for last, (kind, n) in anchors.iter(lowered(text)):
        if kind == "digit":
            if last >= ip_end:
                m = NUMBER_CHAIN.match(text, last)
                ip_end = m.end()
                if text.count(".", last, ip_end) >= 3:
                    at, parts = last, m.group().split(".")
                    for k in range(0, len(parts) - 3, 4):
                        four = parts[k : k + 4]
                        end = at + sum(map(len, four)) + 3
                        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                            out.append((at, end, "ip"))
                        at = end + 1
            if last >= card_end:
                m = DIGIT_CHAIN.match(text, last)
                card_end = m.end()
                if card_end - last >= 14:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((last, card_end, "card"))
        elif kind == "email":
            start = last
            while start > email_end and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                email_end = m.end()
                out.append((start, email_end, "email"))
        elif kind == "phone":
            if last >= phone_end and (m := PHONE_RUN.match(text, last + 1)):
                end = m.end()
                while not "0" <= text[end - 1] <= "9":
                    end -= 1
                if end - last >= 4:
                    phone_end = end
                    if 10 <= sum("0" <= c <= "9" for c in text[last:end]) <= 15:
                        out.append((last, end, "phone"))
        elif kind == "url":
            start = last - n + 1
            if start >= url_end and (m := URL_REST.match(text, last + 1)):
                url_end = last + 1 + len(m.group().rstrip(".,;:!?)"))
                out.append((start, url_end, "url"))
        elif last < n or not text[last - n].isalnum():
            span = iban_at(text, last + 1) if kind == "iban" else account_at(text, last + 1, text[last - n + 1 : last + 1].lower())
            if span:
                out.append((*span, kind))
    return sorted(set(out), key=lambda s: (s[0], RANK[s[2]], s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for each row of ``df``.

    One narrow pass: no shuffle, memory bounded by an Arrow batch. Ids may be null or
    repeated, each row gets a row; other columns are not read. An id column that is named like one of the
    results stands beside it: rename it before.
    """
    narrow = df.select(df[id_col], df[text_col])
    kind = narrow.schema[0].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            sha, spans = [], []
            for text in b.column(1).to_pylist():
                found = find(text, anchors)
                base = [s for s in found if s[2] in BASE]
                for k, name in enumerate(BASE):
                    counts[k].append(sum(s[2] == name for s in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                [id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return narrow.mapInArrow(scan, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(df: DataFrame, text_col: str = "text", mask: str = "<{kind}>") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by its mask; nulls stay null."""
    at = df.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            texts = []
            for text in b.column(at).to_pylist():
                done, parts = 0, []
                for s, e, kind in find(text, anchors):
                    if s >= done:
                        parts += [text[done:s], mask.format(kind=kind)]
                        done = e
                texts.append(text and "".join([*parts, text[done:]]))
            cols = [pa.array(texts, b.schema.field(k).type) if k == at else b.column(k) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return df.mapInArrow(scan, df.schema)
