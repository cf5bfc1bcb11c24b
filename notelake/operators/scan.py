"""Scan for secrets, line by line."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules that hold anywhere.
GENERIC_RULES = r"""
ruta-home:/home/[A-Za-z0-9._-]+/
clave-privada:-----BEGIN [A-Z ]*PRIVATE KEY
aws-key:AKIA[0-9A-Z]{16}
garage-key:GK[0-9a-f]{26}
github-token:(ghp|gho|ghu|ghs)_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{20,}
openai-key:sk-(ant-)?[A-Za-z0-9_-]{20,}
slack-token:xox[baprs]-[A-Za-z0-9-]{10,}
jwt:eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.
credencial-en-claro:(password|passphrase|secret|token|api[_-]?key)[[:space:]]*[:=][[:space:]]*"[^"<>]{8,}"
"""
HIDDEN, SHOWN = "<oculto>", 160
#: Paths that are not scanned, and files with a zero byte.
SKIPPED = r"\.example$|\.md$|^\.githooks/"
_CLASSES = {"[:space:]": r"\s", "[:digit:]": "0-9", "[:alpha:]": "A-Za-z", "[:alnum:]": "A-Za-z0-9", "[:upper:]": "A-Z", "[:lower:]": "a-z"}


def load_rules(text: str) -> list[tuple[str, str, bool]]:
    """``category:regex`` a line, ``!`` before an exception, ``#`` a comment -> distinct (category, pattern, is_exception)."""
    out: dict[tuple[str, str, bool], None] = {}
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        category, _, pattern = line.removeprefix("!").partition(":")
        out[category, pattern, line.startswith("!")] = None
    return list(out)


def java(pattern: str) -> str:
    """A POSIX pattern as Java reads it."""
    for a, b in _CLASSES.items():
        pattern = pattern.replace(a, b)
    return re.sub(r"\[(\\s)\]", r"\1", pattern)


def scan(files: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """``files(path, text)`` -> ``(path, line, categories, shown)``: lines that match a rule and no exception.

    Rules are few: each is a predicate of its own, compiled once, and all run in
    one pass.  ``shown`` is the line with every match hidden, cut to 160
    characters.  An exception is held against ``path:line text``.
    """
    kept = files.where(~F.col("path").rlike(SKIPPED) & ~F.contains("text", F.lit("\0")))
    lines = kept.select("path", F.posexplode(F.split("text", "\n", -1)).alias("at", "content"))
    hit: Column = F.lit(False)
    found, shown = [], F.col("content")
    for category, pattern, exception in rules:
        if not exception:
            match = F.col("content").rlike(java(pattern))
            hit = hit | match
            found.append(F.when(match, F.lit(category)))
            shown = F.regexp_replace(shown, java(pattern), HIDDEN)
    lines = lines.where(hit)
    for _, pattern, exception in rules:
        if exception:
            lines = lines.where(~F.concat_ws(":", "path", "content").rlike(java(pattern)))
    categories = F.array_sort(F.array_distinct(F.array_compact(F.array(*found)))) if found else F.array().cast("array<string>")
    return lines.select("path", (F.col("at") + 1).alias("line"), categories.alias("categories"), F.substring(shown, 1, SHOWN).alias("shown"))


def _class_end(pattern: str, at: int) -> int:
    """Behind the class of characters that begins at ``at``."""
    at += 3 if pattern[at + 1 : at + 2] == "^" else 2
    while at < len(pattern) and pattern[at] != "]":
        at += 2 if pattern[at] == "\\" else 1
    return at + 1


def _pieces(pattern: str) -> list[tuple[str, str]] | None:
    """``(kind, text)`` of a pattern's parts in order: ``lit`` a character, ``group`` what stands in parentheses, ``or``, ``other``; None for what isn't understood.

    What may be missing (``*``, ``?``, a number from 0) is ``other``.
    """
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            kind, text, i = ("other" if pattern[i + 1].isalnum() else "lit"), pattern[i + 1], i + 2
        elif c == "[":
            kind, text, i = "other", "", _class_end(pattern, i)
        elif c == "(":
            end, depth = i + 1, 1
            while end < len(pattern) and depth:
                depth += {"(": 1, ")": -1}.get(pattern[end], 0)
                end = _class_end(pattern, end) if pattern[end] == "[" else end + 1 + (pattern[end] == "\\")
            kind, text, i = "group", pattern[i + 1 : end - 1], end
        elif c in "*?{":
            number = re.match(r"\{(\d+)(?:,\d*)?\}", pattern[i:]) if c == "{" else None
            if not out or c == "{" and not number:
                return None
            if c != "{" or int(number[1]) == 0:
                out[-1] = ("other", "")
            else:
                out.append(("other", ""))  # a repeated character ends a run
            i += number.end() if number else 1
            continue
        elif c == "+":
            out.append(("other", ""))
            i += 1
            continue
        else:
            kind, text, i = "or" if c == "|" else "other" if c in ".^$" else "lit", c, i + 1
        out.append((kind, text))
    return out


def required(pattern: str) -> set[str] | None:
    """Strings of which every match of ``pattern`` holds at least one; None where none are found, or flags or conditions stand in it."""
    if re.search(r"\(\?(?!:)", pattern):
        return None
    pieces = _pieces(pattern)
    if pieces is None:
        return None
    branches: list[list[tuple[str, str]]] = [[]]
    for piece in pieces:
        if piece[0] == "or":
            branches.append([])
        else:
            branches[-1].append(piece)
    out: set[str] = set()
    for branch in branches:
        best: set[str] = set()
        run = ""
        for kind, text in [*branch, ("other", "")]:
            if kind == "lit":
                run += text
                continue
            options = [{run}] if run else []
            if kind == "group" and (inner := required(text.removeprefix("?:"))):
                options.append(inner)
            for own in options:
                if min(map(len, own)) > min(map(len, best), default=0):
                    best = own
            run = ""
        if not best:
            return None
        out |= best
    return out


def scan_many(files: DataFrame, rules: list[tuple[str, str, bool]]) -> DataFrame:
    """``scan`` for thousands of rules: ``(path, line, categories, shown)``.

    Of each rule the strings are taken that a match can't lack; one Aho-Corasick
    pass over a file finds where they stand, and a rule's expression is tried on
    those lines only.  A rule without such strings is tried on every line.
    Expressions are Python's, of ASCII classes; where they mean the same as Java's
    the result is that of ``scan``.  A null text or path has no lines.
    """
    own = [(c, re.compile(java(p), re.ASCII), required(java(p))) for c, p, exception in rules if not exception]
    exceptions = [re.compile(java(p), re.ASCII) for _, p, exception in rules if exception]
    always = [k for k, (_, _, strings) in enumerate(own) if strings is None]
    holders: dict[str, list[int]] = {}
    for k, (_, _, strings) in enumerate(own):
        for text in strings or ():
            holders.setdefault(text, []).append(k)
    kept = files.where("path is not null and text is not null").where(~F.col("path").rlike(SKIPPED) & ~F.contains("text", F.lit("\0"))).select("path", "text")
    kind = "path string, line int, categories array<string>, shown string"
    schema = pa.schema([("path", pa.string()), ("line", pa.int32()), ("categories", pa.list_(pa.string())), ("shown", pa.string())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = ahocorasick.Automaton()
        for text, ks in holders.items():
            anchors.add_word(text, ks)
        if holders:
            anchors.make_automaton()
        for b in batches:
            out = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                lines = text.split("\n")
                ends, at = [], -1
                for line in lines:
                    at += len(line) + 1
                    ends.append(at)  # where the line's break stands
                tried: dict[int, set[int]] = {n: set(always) for n in range(len(lines))} if always else {}
                for last, ks in anchors.iter(text) if holders else ():
                    tried.setdefault(bisect_left(ends, last), set()).update(ks)
                for n in sorted(tried):
                    hits = [k for k in sorted(tried[n]) if own[k][1].search(lines[n])]
                    if hits and not any(e.search(f"{path}:{lines[n]}") for e in exceptions):
                        shown = lines[n]
                        for k in hits:
                            shown = own[k][1].sub(HIDDEN, shown)
                        out.append({"path": path, "line": n + 1, "categories": sorted({own[k][0] for k in hits}), "shown": shown[:SHOWN]})
            yield pa.RecordBatch.from_pylist(out, schema)

    return kept.mapInArrow(each, kind)


def scan_summary(findings: DataFrame) -> DataFrame:
    return findings.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
