"""Markdown chunkers in built-in functions: a note's lines as an array, no shuffle and no Python.

Nothing is carried from line to line.  Fences open and close by turns, so their
positions give the blocks of code; runs begin where a line differs from the one
before; what holds until further notice (a heading, a kind) is the first
element of a section, and sections are cut where it changes.  Only sizes are
summed up greedily, within code or short prose.  Work and memory are linear in
a note's lines, but a note is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A longer code chunk is cut where this many characters have gathered.
LONG_CODE, CODE_PART = 4000, 3000
#: What counts as white space.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_B = f"[{BLANK}]"
HEADING = f"^(#{{1,6}}){_B}+([^\\n]*)"
ROW, ITEM, INDEX_ITEM = r"^\|[^\n]+\|", rf"^{_B}*(?:[-*+]|\p{{Nd}}+\.){_B}", rf"^{_B}*(?:[-*]|\p{{Nd}}+\.){_B}"
#: Positions gathered before they are put aside, so that appending stays cheap.
_HELD = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), body)[0]


def _strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK))


def _join(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "\n")


def _where(xs: Column, holds: Callable[[Column, Column], Column]) -> Column:
    """Positions from 0 of what ``holds``."""
    return F.filter(F.transform(xs, lambda x, i: F.when(holds(x, i), i)), lambda i: i.isNotNull())


def _between(xs: Column, cuts: Column) -> Column:
    """The parts of ``xs``, none of them empty, that begin at 0 and at each of ``cuts``."""
    parts = lambda b: F.transform(b, lambda s, k: F.slice(xs, s + 1, F.coalesce(F.get(b, k + 1), F.size(xs)) - s))
    return F.filter(_let(F.array_distinct(F.concat(F.array(F.lit(0)), cuts)), parts), lambda p: F.size(p) > 0)


def _sections(xs: Column, begins: Callable[[Column, Column, Column], Column], each: Callable[[Column], Column]) -> Column:
    """``each`` of the parts of ``xs`` that begin where ``begins(x, i, before)``, the first wherever it begins."""
    return _let(xs, lambda v: F.transform(_between(v, _where(v, lambda x, i: begins(x, i, F.get(v, i - 1)))), each))


def _greedy(xs: Column, weight: Callable[[Column], Column], limit: int, least: int = 0) -> Column:
    """Parts of ``xs`` that end as soon as their weights reach ``limit``, but not before position ``least``."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("held"), F.array().cast("array<array<int>>").alias("aside"))

    def step(a: Column, x: Column) -> Column:
        size, at = a["size"] + weight(x), a["i"] + 1
        cut = (size >= limit) & (a["i"] >= least)
        full = F.size(a["held"]) >= _HELD
        held = F.when(~cut, a["held"]).when(full, F.array(at)).otherwise(F.array_append(a["held"], at))
        aside = F.when(cut & full, F.array_append(a["aside"], a["held"])).otherwise(a["aside"])
        return F.struct(at.alias("i"), F.when(cut, F.lit(0)).otherwise(size).cast("long").alias("size"), held.alias("held"), aside.alias("aside"))

    ends = F.aggregate(xs, start, step, lambda a: F.concat(F.flatten(a["aside"]), a["held"]))
    return _between(xs, ends)


def _pieces(text: Column, fence: Callable[[Column], Column], kind: Callable[[Column, Column], Column]) -> Column:
    """``(text, kind)`` of each block of code as a whole and of each other line; ``kind(line, bare)``."""

    def blocks(lines: Column, at: Column) -> Column:
        n, pairs = F.size(lines), F.ceil(F.size(at) / 2).cast("int")
        piece = lambda t, k: F.struct(t.alias("text"), k.alias("kind"))
        upto = lambda start, end: F.slice(lines, start + 1, end - start)

        def block(k: Column) -> Column:
            opened = F.coalesce(F.get(at, 2 * k), n)
            since = F.when(k == 0, 0).otherwise(F.coalesce(F.get(at, 2 * k - 1) + 1, n))
            plain = F.transform(upto(since, opened), lambda x: piece(x, _let(_strip(x), lambda bare: kind(x, bare))))
            code = piece(F.array_join(upto(opened, F.coalesce(F.get(at, 2 * k + 1) + 1, n)), "\n"), F.lit("code"))
            return F.when(k < pairs, F.concat(plain, F.array(code))).otherwise(plain)

        return F.flatten(F.transform(F.sequence(F.lit(0), pairs), block))

    return _let(F.split(text, "\n"), lambda lines: _let(_where(lines, lambda x, i: fence(F.ltrim(x, F.lit(BLANK)))), lambda at: blocks(lines, at)))


def _chunk(heading: Column, level: Column, kind: Column, text: Column) -> Column:
    return F.struct(heading.alias("heading"), level.cast("int").alias("hlevel"), kind.alias("ctype"), text.alias("text"))


def semantic_chunks(text: Column, min_chars: int = 80) -> Column:
    """Chunks in order: code, tables and lists by themselves, short prose joined to what follows."""
    whole = F.coalesce(text, F.lit(""))

    def kind(line: Column, bare: Column) -> Column:
        head = bare.rlike(HEADING)
        return F.when(bare == "", F.lit(None)).when(head, F.lit("head")).when(bare.rlike(ROW), F.lit("table")).when(line.rlike(ITEM), F.lit("list")).otherwise(F.lit("prose"))

    pieces = _pieces(whole, lambda b: b.startswith("```") | b.startswith("~~~"), kind)
    as_one = lambda part: F.struct(_join(part).alias("text"), part[0]["kind"].alias("kind"))
    # Blank lines go with the line before them.
    lines = F.filter(_sections(pieces, lambda x, i, b: x["kind"].isNotNull(), as_one), lambda x: x["kind"].isNotNull())
    runs = _sections(lines, lambda x, i, b: x["kind"].isin("code", "head") | ~x["kind"].eqNullSafe(b["kind"]), as_one)

    def under(part: Column) -> Column:
        def of(title: Column, level: Column) -> Column:
            chunks = F.transform(part, lambda x: _chunk(title, level, x["kind"], _strip(x["text"])))
            return F.filter(chunks, lambda c: (c["ctype"] != "head") & (c["text"] != ""))

        line = _strip(part[0]["text"])
        head = F.coalesce(part[0]["kind"] == "head", F.lit(False))
        title = F.when(head, _strip(F.regexp_extract(line, HEADING, 2))).otherwise(F.lit(""))
        return _let(F.struct(title.alias("t"), F.when(head, F.length(F.regexp_extract(line, HEADING, 1))).otherwise(0).alias("n")), lambda h: of(h["t"], h["n"]))

    chunks = F.flatten(_sections(runs, lambda x, i, b: x["kind"] == "head", under))

    def cut(c: Column) -> Column:
        parts = F.transform(_let(F.split(c["text"], "\n"), lambda v: _greedy(v, lambda x: F.length(x) + 1, CODE_PART)), lambda p: _chunk(c["heading"], c["hlevel"], c["ctype"], _strip(F.array_join(p, "\n"))))
        return F.when((c["ctype"] == "code") & (F.length(c["text"]) > LONG_CODE), parts).otherwise(F.array(c))

    def joined(part: Column) -> Column:
        text = F.array_join(F.transform(part, lambda c: c["text"]), "\n\n")
        return _chunk(part[0]["heading"], part[0]["hlevel"], part[0]["ctype"], text)

    # Nothing is joined to code, tables, lists or prose that is long enough; between them prose gathers until it is.
    ready = lambda b: (b["ctype"] != "prose") | (F.length(b["text"]) >= min_chars)
    small = _sections(F.flatten(F.transform(chunks, cut)), lambda x, i, b: (i == 0) | (x["ctype"] != "prose") | ready(b), lambda p: p)
    out = F.flatten(F.transform(small, lambda p: F.transform(_greedy(p, lambda c: F.length(c["text"]) + 2, min_chars + 2), joined)))
    one = lambda t: F.array(_chunk(F.lit(""), F.lit(0), F.lit("prose"), t))
    return F.when(F.length(_strip(whole)) < min_chars, one(_strip(whole))).otherwise(_let(out, lambda o: F.when(F.size(o) > 0, o).otherwise(one(F.substring(_strip(whole), 1, 2000)))))


def index_chunks(text: Column, min_chars: int = 120, keep_short: bool = True) -> Column:
    """As ``semantic_chunks``, finer: a chunk for each table row and list item, headings stay in the text.

    ``keep_short=False`` drops prose below ``min_chars`` unless it is a note's first chunk.
    """
    whole = F.coalesce(text, F.lit(""))
    own = ("code", "head", "table", "list")

    def kind(line: Column, bare: Column) -> Column:
        head = line.rlike(HEADING)
        return F.when(bare == "", F.lit(None)).when(head, F.lit("head")).when(bare.startswith("|"), F.lit("table")).when(line.rlike(INDEX_ITEM), F.lit("list")).otherwise(F.lit("plain"))

    def part_of(p: Column) -> Column:
        return F.struct(_join(p).alias("text"), F.coalesce(p[0]["kind"], F.lit("plain")).alias("kind"), F.when(p[0]["kind"] == "head", p[0]["text"]).alias("line"))

    pieces = _pieces(whole, lambda b: b.startswith("```"), kind)
    runs = _sections(pieces, lambda x, i, b: F.coalesce(x["kind"].isin(*own), F.lit(False)) | b["kind"].isNull() | (b["kind"] == "code"), part_of)

    def of_kind(p: Column) -> Column:
        """What follows code or a heading is prose, what follows an item or a row is of its kind."""
        first = p[0]["kind"]
        rest = F.when(first.isin("table", "list"), first).otherwise(F.lit("prose"))
        return F.transform(p, lambda x, i: F.struct(x["text"], F.when((i == 0) & (first == "code"), first).otherwise(rest).alias("kind"), x["line"]))

    kinds = F.flatten(_sections(runs, lambda x, i, b: x["kind"].isin(*own), of_kind))

    def under(p: Column) -> Column:
        def cut(x: Column, title: Column, level: Column) -> Column:
            parts = _let(F.split(x["text"], "\n"), lambda v: _greedy(v, F.length, CODE_PART + 1, 1))
            texts = F.when((x["kind"] == "code") & (F.length(x["text"]) > CODE_PART), F.transform(parts, lambda q: F.array_join(q, "\n"))).otherwise(F.array(x["text"]))
            return F.transform(texts, lambda t: _chunk(title, level, x["kind"], _strip(t)))

        line = p[0]["line"]
        title, level = _strip(F.regexp_extract(line, HEADING, 2)), F.coalesce(F.length(F.regexp_extract(line, HEADING, 1)), F.lit(0))
        return _let(F.struct(title.alias("t"), level.alias("n")), lambda h: F.flatten(F.transform(p, lambda x: cut(x, h["t"], h["n"]))))

    out = F.filter(F.flatten(_sections(kinds, lambda x, i, b: x["line"].isNotNull(), under)), lambda c: c["text"] != "")
    if not keep_short:
        out = F.filter(out, lambda c, i: (i == 0) | (c["ctype"] != "prose") | (F.length(c["text"]) >= min_chars))
    return F.when(F.length(_strip(whole)) >= 20, out)


def _chunked(notes: DataFrame, chunks: Column) -> DataFrame:
    return notes.select("path", F.posexplode(chunks).alias("ord", "c")).select("path", "ord", "c.*")


def chunk_notes(notes: DataFrame, min_chars: int = 80) -> DataFrame:
    """``notes(path, text)`` -> ``(path, ord, heading, hlevel, ctype, text)`` by ``semantic_chunks``.

    A row is cut by itself, also one that repeats a path or has none; a null
    text is an empty one, which is a chunk.  Other columns don't matter.
    """
    return _chunked(notes, semantic_chunks(F.col("text"), min_chars))


def chunk_notes_index(notes: DataFrame, min_chars: int = 120, keep_short: bool = True) -> DataFrame:
    """``notes(path, text)`` -> ``(path, ord, heading, hlevel, ctype, text)`` by ``index_chunks``.

    As ``chunk_notes``, but a null or empty text has no chunks.
    """
    return _chunked(notes, index_chunks(F.col("text"), min_chars, keep_short))
