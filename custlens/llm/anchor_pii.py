"""Personal data by anchor expansion.

One Aho-Corasick pass per text finds anchors: at-signs, plus signs, digits,
schemes and identifier cues.  A local parser per kind grows the span outward from
its anchor and validates it (label structure, octets, Luhn, digit counts, IBAN
remainder).  A text without an anchor costs no more than the pass.

Kinds, in order: email, ip, card, phone (the base kinds), then
address (a URL that carries a user name, or mailto:), account (IBAN; a number
after a cue such as "account no"; 123-45-6789 after "ssn"), secret (a value after
"password", "token", "api_key", "secret"; an access key id).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import arrow_types, as_batch, map_arrow

KINDS = ["email", "ip", "card", "phone", "address", "account", "secret"]
BASE_KINDS = KINDS[:4]
_RANK = {k: i for i, k in enumerate(KINDS)}
_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]+")
_URL = re.compile(r"//[A-Za-z0-9._~%!$&'*+,;=-]+(?::[^\s/@]*)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?[^\s\"'<>]*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?: ?(?:number|num|no|nr|id))?\.?\s?[:#=]?\s?([0-9](?:[ -]?[0-9]){5,17})(?![A-Za-z0-9])", re.I)
_SSN = re.compile(r"\s?[:#=]?\s?([0-9]{3}-[0-9]{2}-[0-9]{4})(?![A-Za-z0-9])")
_VALUE = re.compile(r"\s?[:=]\s?[\"']?([A-Za-z0-9_\-./+]{8,})")
_KEY = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
#: Cue (lower case) -> parser.
CUES = {"account": "number", "acct": "number", "passport": "number", "iban": "iban", "ssn": "ssn", "password": "value", "passwd": "value",
        "token": "value", "api_key": "value", "apikey": "value", "secret": "value", "akia": "key", "mailto:": "mail", "://": "url"}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, c)
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, cue)
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points by start, then kind as listed.  Spans of a
    base kind do not overlap one another and a failed one is not tried again
    further in; spans of different kinds may overlap."""
    out: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)

    def add(kind: str, start: int, end: int, good: bool = True) -> None:
        if start >= done[kind]:
            done[kind] = end
            if good:
                out.append((start, end, kind))

    run_end = 0
    for last, anchor in _ANCHORS.iter(text):
        at = last - len(anchor) + 1
        if anchor in _DIGITS:
            if at >= done["card"]:
                m = _CARD.match(text, at)
                if m:
                    d = _digits(m[0])
                    add("card", at, m.end(), 14 <= len(d) <= 19 and luhn(d))
                else:
                    done["card"] = at + 1
            if at >= done["ip"] and at >= run_end:
                m = _IP.match(text, at)
                if m:
                    add("ip", at, m.end(), all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in m[0].split("."))))
                    run_end = m.end()
                else:
                    run_end = _RUN.match(text, at).end()
        elif anchor == "@":
            start = at
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                add("email", start, m.end())
        elif anchor == "+":
            m = _PHONE.match(text, at) if at >= done["phone"] else None
            if m:
                add("phone", at, m.end(), 10 <= len(_digits(m[0])) <= 15)
        else:
            _cue(text, at, last + 1, CUES[anchor], add)
    out.sort(key=lambda s: (s[0], _RANK[s[2]]))
    return out


def _cue(text: str, at: int, end: int, parser: str, add) -> None:
    if parser == "url":
        start = at
        while start > 0 and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "+.-"):
            start -= 1
        m = _URL.match(text, at + 1)
        if m and start < at:
            add("address", start, m.end())
    elif parser == "mail":
        m = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match(text, end)
        if m:
            add("address", at, m.end())
    elif parser == "iban":
        m = _IBAN.match(text, end + len(text[end:end + 3]) - len(text[end:end + 3].lstrip(" :=#")))
        if m and _iban(m[0]):
            add("account", m.start(), m.end())
    elif parser == "key":
        m = _KEY.match(text, at)
        if m and (at == 0 or not text[at - 1].isalnum()):
            add("secret", at, m.end())
    else:
        m = {"number": _NUMBER, "ssn": _SSN, "value": _VALUE}[parser].match(text, end)
        if m and (at == 0 or not text[at - 1].isalnum()):
            v = m[1]
            if parser != "value" or (any(c in _DIGITS for c in v) and any(c.isalpha() for c in v)):
                add("secret" if parser == "value" else "account", m.start(1), m.end(1))


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, or run of overlapping spans, as [KIND] of its first."""
    parts, at = [], 0
    end, kind, start = -1, "", 0
    for a, b, k in [*spans, (len(text) + 1, len(text) + 1, "")]:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            parts += [text[at:start], f"[{kind.upper()}]"]
            at = end
        start, end, kind = a, b, k
    return "".join(parts) + text[at:]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.  A null or
    empty text has no span; a null doc_id stays; repeated rows are searched each;
    only doc_id and text are read; an empty table gives an empty one."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    types = arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = [find_spans(t) if t else [] for t in b.column(1).to_pylist()]
                base = [[s for s in f if s[2] in BASE_KINDS] for f in found]
                counts = [[sum(s[2] == k for s in f) for f in base] for k in BASE_KINDS]
                yield as_batch([b.column(0), *counts, [hashlib.sha256(spans_text(f).encode()).hexdigest() for f in base], [spans_text(f) for f in found]], types)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans of column text replaced; texts without one are left as
    they are, and so are null texts and other columns.  A column n_chars follows
    the new text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    types, text = to_arrow_schema(docs.schema), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                new = [redact(t, s) if t and (s := find_spans(t)) else t for t in b.column(text).to_pylist()]
                yield as_batch([*b.columns[:text], new, *b.columns[text + 1:]], types)

    out = map_arrow(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
