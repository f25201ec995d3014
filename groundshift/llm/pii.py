"""Personal data in texts by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, schemes, digit groups, plus signs, identifier cues); deterministic
parsers expand each anchor to the left and right and validate what they find. No pattern is run over the text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds, then the kinds that anchors add, in the order that ties at one start are listed.
BASE = ("email", "ip", "card", "phone")
ADDED = ("login", "ipv6", "iban", "secret", "key")
KINDS = BASE + ADDED

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
ALNUM = DIGITS | LETTERS
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
HEX = DIGITS | frozenset("abcdefABCDEF")
USERINFO = ALNUM | frozenset("._~!$&'()*+,;=:%-")
SECRET = ALNUM | frozenset("+/=_-.~")
CUES = ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey", "access_key")
#: Marks that begin an access key, and how many letters and digits follow.
KEY_MARKS = {"AKIA": 16, "ASIA": 16, "ghp_": 36}
#: A cued value of at least this many characters, with a digit, is a secret.
SECRET_LEAST = 8
# IBAN lengths of the SWIFT registry for the countries that are looked for.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    out.add_word("@", "email")
    out.add_word("://", "login")
    for d in "0123456789":
        out.add_word(f"+{d}", "phone")
        out.add_word(f"{d}.", "ip")
        for e in "0123456789":
            for sep in ("", " ", "-"):
                out.add_word(f"{d}{sep}{e}", "card")
    for c in IBAN_LENGTHS:
        for d in "0123456789":
            out.add_word(f"{c}{d}", "iban")
    for a in "0123456789abcdefABCDEF":
        out.add_word(f"{a}:", "ipv6")
    out.add_word("::", "ipv6")
    for mark in KEY_MARKS:
        out.add_word(mark, "key")
    for cue in CUES:
        for word in {cue, cue.upper(), cue.capitalize()}:
            out.add_word(word, "secret")
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def run_of(text: str, at: int, chars: frozenset, end: int) -> int:
    """End of the run of chars that begins at `at`."""
    while at < end and text[at] in chars:
        at += 1
    return at


def run_before(text: str, at: int, chars: frozenset, least: int) -> int:
    """Start of the run of chars that ends before `at`, not before `least`."""
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


def _email(text: str, at: int, least: int, n: int) -> tuple[int, int, bool] | None:
    start = run_before(text, at, LOCAL, least)
    end = run_of(text, at + 1, LABEL, n)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < n and text[end] == "." and (more := run_of(text, end + 1, LABEL, n)) > end + 1:
        end, dots = more, dots + 1
    return (start, end, True) if dots else None


def _ip(text: str, at: int, least: int, n: int) -> tuple[int, int, bool] | None:
    start = run_before(text, at, DIGITS, least)
    if start == at:
        return None
    end, parts = at, [text[start:at]]
    while len(parts) < 4 and end < n and text[end] == "." and (more := run_of(text, end + 1, DIGITS, n)) > end + 1:
        parts.append(text[end + 1 : more])
        end = more
    if len(parts) < 4:
        return None
    return start, end, all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _card(text: str, at: int, least: int, n: int) -> tuple[int, int, bool] | None:
    # The scan begins a chain at its first digit, so only the right side is expanded.
    end, digits = at + 1, [text[at]]
    while end < n:
        if text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    if len(digits) < 2:
        return None
    return at, end, 14 <= len(digits) <= 19 and luhn("".join(digits))


def _phone(text: str, at: int, least: int, n: int) -> tuple[int, int, bool] | None:
    end = run_of(text, at + 2, PHONE, n)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return at, end, 10 <= sum(c in DIGITS for c in text[at:end]) <= 15


def _login(text: str, at: int, least: int, n: int) -> tuple[int, int, bool] | None:
    """scheme://user:password@host"""
    start = run_before(text, at, ALNUM, least)
    user = run_of(text, at + 3, USERINFO, n)
    if start == at or user == n or text[user] != "@" or ":" not in text[at + 3 : user]:
        return None
    host = run_of(text, user + 1, LABEL | {"."}, n)
    return (start, host, True) if host > user + 1 else None


def _ipv6(text: str, at: int, least: int, n: int) -> tuple[int, int, bool] | None:
    """Eight groups of hexadecimal digits, or fewer with one `::`; groups of at most four digits."""
    start = run_before(text, at, HEX | {":"}, least)
    end = run_of(text, at, HEX | {":"}, n)
    if start and text[start - 1] in ALNUM or end < n and text[end] in ALNUM:
        return start, end, False
    body = text[start:end]
    if body.count("::") > 1 or ":::" in body or (body[0] == ":" and body[:2] != "::") or (body[-1] == ":" and body[-2:] != "::"):
        return start, end, False
    groups = [g for g in body.split(":") if g]
    ok = all(len(g) <= 4 for g in groups) and (2 <= len(groups) <= 7 if "::" in body else len(groups) == 8)
    return start, end, ok


def _iban(text: str, at: int, least: int, n: int) -> tuple[int, int, bool] | None:
    if at and text[at - 1] in ALNUM:
        return None
    want, end, found = IBAN_LENGTHS[text[at : at + 2]], at, []
    while end < n and len(found) < want:
        if text[end] in ALNUM:
            found.append(text[end].upper())
        elif text[end] != " " or len(found) % 4:
            break
        end += 1
    if len(found) < want or end < n and text[end] in ALNUM:
        return None
    moved = "".join(found[4:] + found[:4])
    return at, end, int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _secret(text: str, at: int, least: int, n: int) -> tuple[int, int, bool] | None:
    """The value after a cue and `=` or `:`; `at` is the cue's end."""
    i = at
    while i < n and i < at + 2 and text[i] in " \"'":
        i += 1
    if i >= n or text[i] not in "=:":
        return None
    i += 1
    while i < n and i < at + 6 and text[i] in " \"'":
        i += 1
    end = run_of(text, i, SECRET, n)
    while end > i and text[end - 1] == ".":
        end -= 1
    value = text[i:end]
    return (i, end, len(value) >= SECRET_LEAST and any(c in DIGITS for c in value)) if value else None


def _key(text: str, at: int, least: int, n: int) -> tuple[int, int, bool] | None:
    """An access key: a known mark and its number of letters and digits, standing alone."""
    mark = text[at : at + 4]
    end = run_of(text, at + 4, ALNUM, n)
    if at and text[at - 1] in ALNUM:
        return None
    return at, end, end - at - 4 == KEY_MARKS[mark]


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "login": _login, "ipv6": _ipv6, "iban": _iban, "secret": _secret, "key": _key}


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data in text, by start, then kind; code points, end exclusive.

    Spans of one kind never overlap: each kind's parser takes up where its last match, valid or not, ended.
    """
    n, free, found = len(text), dict.fromkeys(KINDS, 0), []
    for end, kind in automaton().iter(text):
        least = free[kind]
        if kind == "email":
            at = end
        elif kind == "ip":
            at = end  # the dot
        elif kind == "card":
            at = end - 1 if text[end - 1] in DIGITS else end - 2
        elif kind == "phone":
            at = end - 1
        elif kind == "login":
            at = end - 2
        elif kind == "ipv6":
            at = end
        elif kind == "iban":
            at = end - 2
        elif kind == "key":
            at = end - 3
        else:
            at = end + 1
        if at < least:
            continue
        match = PARSERS[kind](text, at, least, n)
        if match:
            free[kind] = match[1]
            if match[2]:
                found.append((kind, match[0], match[1]))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans, the first, then the longest."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, spans array<struct<kind,start,end>>, redacted text.

    Whole texts, no shuffle. A null or empty text has no spans and an empty redacted text; repeated rows, null ids and
    other columns don't matter; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                spans = [find_spans(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], kind), pa.array([redact(t, s) for t, s in zip(texts, spans, strict=True)], pa.string())], names=["doc_id", "spans", "redacted"])

    return _source(df, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>, redacted string")


def pii_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of base kinds, base_sha256 and all spans as text; see pii_spans for the defined cases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                spans = [find_spans(t or "") for t in part.column(1).to_pylist()]
                counts = [pa.array([sum(k == kind for k, _, _ in s) for s in spans], pa.int64()) for kind in BASE]
                digests = [hashlib.sha256(joined([x for x in s if x[0] in BASE]).encode()).hexdigest() for s in spans]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digests, pa.string()), pa.array([joined(s) for s in spans], pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return _source(df, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_column(df: DataFrame, text_col: str = "text", n_chars_col: str | None = "n_chars") -> DataFrame:
    """df with personal data in text_col replaced by kinds in brackets, all columns and rows kept; null texts stay null."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            yield pd.Series([None if t is None else redact(t, find_spans(t)) for t in texts], dtype=object)

    out = df.withColumn(text_col, F.pandas_udf(run, "string")(F.col(text_col).cast("string")))
    return out.withColumn(n_chars_col, F.length(text_col).cast(df.schema[n_chars_col].dataType)) if n_chars_col and n_chars_col in df.columns else out
