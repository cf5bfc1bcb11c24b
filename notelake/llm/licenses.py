"""License scans by an exact set-similarity join, with built-in functions only.

A template is found in a block of a text that contains enough of its distinct
words.  Blocks are as long as the template asks for: two steps, of which each
holds the whole template, so a text of any length lies whole in some block.  The
templates' words are put in order of the number of documents that hold them,
rarest first.  A document with such a block shares at least one of the first
``size - need + 1`` words of the template (prefix filter), has enough words of
templates at all (length filter), and enough of them are left after a shared one
(positional filter).  Only the documents that pass are cut into blocks, which
are counted exactly.  The templates are a fixed list, so their side of the joins
is broadcast.

Beside that, places where fixed phrases stand word by word are counted.  One
scan of the texts finds those and each document's words of templates; a second
one reads the texts of the documents that the join leaves.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from .license_texts import STATEMENTS, TEXTS

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = STATEMENTS + TEXTS
#: Of a template's distinct words so many must stand in a block; of one with fewer than SHORT, all.
THRESHOLD, SHORT = 0.85, 20
#: The shortest step from block to block.
STEP = 16
#: Documents found by the join that a scan may be given whole; more are joined by shuffle.
BROADCAST_FOUND = 1_000_000
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(template: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", template.lower())


def need(template: str) -> int:
    """How many of the template's distinct words a block must contain."""
    size = len(set(words_of(template)))
    return size if size < SHORT else math.ceil(THRESHOLD * size - 1e-9)


def step_of(template: str) -> int:
    """Words from block to block: a power of two that the template doesn't exceed."""
    return max(STEP, 1 << (len(words_of(template)) - 1).bit_length())


def _spaced(text: Column) -> Column:
    """The words of a text between single spaces; only A to Z are lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(low, NO_WORD, " "))


def _words(spaced: Column) -> Column:
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _strings(words) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def _rows(docs: DataFrame, *structs: Column) -> DataFrame:
    """A small fixed table."""
    return docs.sparkSession.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _base(spaced: Column) -> list[Column]:
    """What the phrases give: n_words, n_base, first_word, last_word, own labels."""
    marked = F.concat(F.lit(" "), spaced, F.lit(" "))
    parts = F.split(marked, " (?=(?:" + "|".join(PHRASES) + ") )", -1)
    n_words, n_base = F.when(spaced == "", 0).otherwise(_spaces(spaced) + 1).cast("long"), (F.size(parts) - 1).cast("long")
    labels = F.array_compact(F.array(*[F.when(F.contains(marked, F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()]))
    return [
        n_words.alias("n_words"), n_base.alias("n_base"),
        F.when(n_base > 0, _spaces(F.element_at(parts, 1))).cast("long").alias("first_word"),
        F.when(n_base > 0, n_words - _spaces(F.element_at(parts, -1))).cast("long").alias("last_word"),
        labels.alias("own_labels"),
    ]


def _scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, tie, held, ...)``: each document's distinct words of templates, and what the phrases give."""
    vocabulary = sorted({w for _, t in templates for w in words_of(t)})
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), _spaced(F.col(text_col)).alias("s"))
    return materialize(d.select("doc_id", "tie", F.array_intersect(_words(F.col("s")), _strings(vocabulary)).alias("held"), *_base(F.col("s"))))


def _found(docs: DataFrame, scanned: DataFrame, templates: tuple[tuple[str, str], ...], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, tie, label, start, words, contained)``: every block that contains a template, once for repeated rows."""
    # As many rows as the templates have words.
    held = scanned.select(F.explode("held").alias("w")).groupBy("w").count()
    count = {r["w"]: r["count"] for r in held.collect()}
    order = sorted({w for _, t in templates for w in words_of(t)}, key=lambda w: (count.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    sides, prefix = [], []
    for k, (label, t) in enumerate(templates):
        ws = sorted(set(words_of(t)), key=rank.__getitem__)
        sides.append(F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), _strings(ws).alias("ws"), F.lit(need(t)).alias("need"), F.lit(step_of(t)).alias("step")))
        prefix += [F.struct(F.lit(w).alias("word"), F.lit(k).alias("t"), F.lit(i).alias("pos")) for i, w in enumerate(ws[: len(ws) - need(t) + 1])]
    if not templates:
        return scanned.limit(0).select("doc_id", "tie", F.lit("").alias("label"), F.lit(0).alias("start"), F.lit(0).alias("words"), F.lit(0.0).alias("contained"))
    sides = F.broadcast(_rows(docs, *sides))
    probes = scanned.select("doc_id", "tie", F.array_intersect(_strings(order), "held").alias("own")).where(F.size("own") >= min(need(t) for _, t in templates))
    near = probes.select("doc_id", "tie", "own", F.posexplode("own").alias("at", "w")).join(F.broadcast(_rows(docs, *prefix)), F.col("w") == F.col("word"))
    near = near.join(sides, F.col("t") == F.col("k"))
    enough = F.least(F.col("at"), F.col("pos")) + 1 + F.least(F.size("own") - 1 - F.col("at"), F.size("ws") - 1 - F.col("pos"))
    near = near.where((F.size("own") >= F.col("need")) & (enough >= F.col("need")) & (F.size(F.array_intersect("own", "ws")) >= F.col("need")))
    near = materialize(near.groupBy(F.col("doc_id").alias("nd"), F.col("tie").alias("nt")).agg(F.collect_set("k").alias("ks")))

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    d = d.join(F.broadcast(near) if near.count() <= BROADCAST_FOUND else near, d.doc_id.eqNullSafe(F.col("nd")) & (d.tie == F.col("nt")))
    d = d.select("doc_id", "tie", "ks", _words(_spaced(F.col("text"))).alias("w"))
    d = d.select("doc_id", "tie", "w", F.explode("ks").alias("t")).join(sides, F.col("t") == F.col("k"))
    last = F.greatest(F.ceil((F.size("w") - F.col("step")) / F.col("step")).cast("int") - 1, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((i * F.col("step")).alias("start"), F.slice("w", i * F.col("step") + 1, 2 * F.col("step")).alias("words")))
    blocks = d.select("doc_id", "tie", "label", "ws", "need", F.explode(cut).alias("b"))
    blocks = blocks.withColumn("shared", F.size(F.array_intersect("ws", "b.words"))).where("shared >= need")
    contained = (F.col("shared") / F.size("ws")).alias("contained")
    return blocks.select("doc_id", "tie", "label", F.col("b.start").alias("start"), F.size("b.words").alias("words"), contained).distinct()


def matches(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, label, start, words, contained)``: every block, by its first word and its length, that contains a template.

    Nulls, repeats and other columns as in ``scan``; repeated rows have their blocks once.
    """
    return _found(docs, _scanned(docs, templates, id_col, text_col), templates, id_col, text_col).drop("tie")


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)`` of every row.

    ``score`` is 1 with a place of a phrase, else the largest containment of a
    template that was found, else 0.  A null text is empty.  Rows alike in id and
    text are answered alike; ids may be null.  Other columns are left out.
    """
    base = _scanned(docs, templates, id_col, text_col)
    found = _found(docs, base, templates, id_col, text_col).groupBy("doc_id", "tie").agg(F.collect_set("label").alias("found"), F.max("contained").alias("contained"))
    found = found.select(F.col("doc_id").alias("fd"), F.col("tie").alias("ft"), "found", "contained")
    out = base.join(found, base.doc_id.eqNullSafe(found.fd) & (base.tie == found.ft), "left")
    every = F.concat("own_labels", F.coalesce("found", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("own_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )
