"""Personal data found from anchors.

One Aho-Corasick pass over a text finds all anchors: at-signs, a plus before a
digit, digits that a dot, a hyphen, a space or nothing separates, ``://``, and cues such
as "account number".  Only there a parser expands to the left and right and
validates what it has: a text without anchors is passed once and no more.

Of each kind the matches are those that its pattern (PATTERNS) has from left to
right without overlap; one that isn't valid is dropped, and the search goes on
behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In this order spans are listed; the first four are the base.
BASE, MORE = ("email", "ip", "card", "phone"), ("account", "iban", "login", "ssn")
#: What introduces an identifier, in lower case; capitals throughout or at the start are cues too.
CUES = {
    "account": ("account number", "account no", "acct", "passport", "passport number"),
    "iban": ("iban",),
    "ssn": ("ssn", "social security number"),
}
_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = _LOCAL - set("_%")


def forms(cue: str) -> list[str]:
    return [cue, cue.upper(), cue.capitalize()]


_AFTER_CUE = r"[ \t:#=.]{1,3}"
_OWN = {
    "account": r"[A-Z]{0,3}[0-9][0-9-]{4,16}[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: What each kind's matches are, whole; of those with a cue the second group is the span.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "login": r"[A-Za-z][A-Za-z0-9+.-]*://[^ \t\n\r\f\v/?#@:]+:[^ \t\n\r\f\v/?#@]+@[A-Za-z0-9.-]+",
    **{kind: f"({'|'.join(f for cue in cues for f in forms(cue))}){_AFTER_CUE}({_OWN[kind]})" for kind, cues in CUES.items()},
}
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP, _CARD, _PHONE = (re.compile(PATTERNS[k]) for k in ("ip", "card", "phone"))
_LOGIN = re.compile(PATTERNS["login"].partition("*")[2])
_CUED = {kind: re.compile(f"{_AFTER_CUE}({own})") for kind, own in _OWN.items()}


def luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for k, d in enumerate(reversed(digits))) % 10 == 0


def _figures(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def valid(kind: str, text: str) -> bool:
    """Whether what a pattern has found is one."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 if len(p) < 100 else not p.strip("0") for p in text.split("."))
    if kind == "card":
        return len(text) <= 37 and 13 <= len(d := _figures(text)) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_figures(text)) <= 15
    if kind == "iban":
        own = text.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1
    if kind == "ssn":
        return text[:3] not in ("000", "666") and text[0] != "9" and text[4:6] != "00" and text[7:] != "0000"
    return True


@lru_cache(1)
def _anchors() -> ahocorasick.Automaton:
    """Words, each with the kind to try and its own length."""
    words: dict[str, list[str]] = {"@": ["email"], "://": ["login"]}
    for a in _DIGITS:
        words[f"+{a}"] = ["phone"]
        for b in _DIGITS:
            words[f"{a}.{b}"] = ["ip"]
            words |= {f"{a}{between}{b}": ["card"] for between in ("", " ", "-")}
    for kind, cues in CUES.items():
        for cue in cues:
            words |= {f: [kind] for f in forms(cue)}
    out = ahocorasick.Automaton()
    for w, kinds in words.items():
        out.add_word(w, (kinds[0], len(w)))
    out.make_automaton()
    return out


def _back(text: str, at: int, low: int, inside: frozenset[str]) -> int:
    """Where the characters of ``inside`` that end at ``at`` begin, not before ``low``."""
    while at > low and text[at - 1] in inside:
        at -= 1
    return at


_FIGURE = frozenset(_DIGITS)


def _expand(kind: str, text: str, at: int, size: int, low: int) -> tuple[int, int, int] | None:
    """Start, end and where the match began, of what an anchor at ``at`` belongs to; None if to nothing.  ``low``: where the kind's last match ended."""
    if kind == "email":
        start = _back(text, at, low, _LOCAL)
        m = _DOMAIN.match(text, at) if start < at else None
        return (start, m.end(), start) if m else None
    if kind == "ip":
        # An earlier part of the same number would have been an anchor itself.
        start = _back(text, at, low, _FIGURE)
        m = _IP.match(text, start)
    elif kind == "card":
        start, m = at, _CARD.match(text, at)
    elif kind == "phone":
        start, m = at, _PHONE.match(text, at)
    elif kind == "login":
        start, m = _back(text, at, low, _SCHEME), None
        while start < at and not text[start].isalpha():
            start += 1
        if start < at:
            m = _LOGIN.match(text, at)
    else:
        m = _CUED[kind].match(text, at + size)
        return (m.start(1), m.end(1), at) if m else None
    return (start, m.end(), start) if m else None


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` in characters, by kind in the order of BASE and MORE, then by start."""
    found: dict[str, list[tuple[str, int, int]]] = {}
    past: dict[str, int] = {}
    for last, (kind, size) in _anchors().iter(text) if text else ():
        at, low = last - size + 1, past.get(kind, 0)
        if at < low:
            continue
        own = _expand(kind, text, at, size, low)
        if own:
            past[kind] = own[1]
            if valid(kind, text[own[0] : own[1]]):
                found.setdefault(kind, []).append((kind, own[0], own[1]))
    return [s for kind in (*BASE, *MORE) for s in found.get(kind, ())]


def listed(own: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in own)


_KINDS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row a row of ``docs``.

    The numbers and the hash are of the base kinds, ``spans`` lists all:
    ``kind:start:end`` in characters, comma-joined.  A null text is empty; no
    spans are an empty string.  Rows are judged by their text alone, so repeated
    rows and rows without an id are like any other; other columns are left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in b.column(1):
                own = spans(text.as_py())
                base = [s for s in own if s[0] in BASE]
                kinds = [s[0] for s in base]
                for column, value in zip(out, [*(kinds.count(k) for k in BASE), sha256(listed(base).encode()).hexdigest(), listed(own)], strict=True):
                    column.append(value)
            arrays = [pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(out)]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], [k.split()[0] for k in _KINDS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, _KINDS)


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets, the longest of those that overlap; other columns as they came."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def cover(text: str | None) -> str | None:
        out, end = [], 0
        for kind, a, b in sorted(spans(text), key=lambda s: (s[1], -s[2])):
            if a >= end:
                out += [text[end:a], f"[{kind}]"]
                end = b
            elif b > end:  # what juts out behind the one before goes with it
                end = b
        return text if not end else "".join(out) + text[end:]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([cover(t.as_py()) for t in b.column(at)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([text if k == at else c for k, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(each, schema)
