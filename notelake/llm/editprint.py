"""Document fingerprints by a randomised edit embedding.

A walk reads a text with shared random bits: at step ``j`` it writes the current
character and moves on if the bit of ``(j, character)`` says so, else it stays.
Two walks over similar texts fall into step again soon after each edit, so few
edits give a small Hamming distance of what is written (and many a large one).
A character is written twice on average; the walk goes on to the text's end.

The fingerprint samples K places of the written string, the same for all texts:
for a string of length L the k-th place is that of a jump hash into L, so texts of
different lengths share as many places as their lengths allow.  At each place it
keeps four bits of a hash of the written character and those that follow it in
the text, one hex digit.  Bands of sampled digits find candidate pairs, which are
then verified by the share of equal digits.

The bits repeat after PERIOD steps, so the steps over two characters depend only
on these and the step's phase: they are kept in a table of pairs.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import connected_components, keep, materialize
from .simhash import spanning

#: Hex digits of a fingerprint, period of the random bits, characters hashed at a place.
DIGITS, PERIOD, REACH = 64, 64, 6
#: Fingerprints of a tile, about, in which a band's candidates are verified.
TILE = 1024
#: Of pairs just at the threshold, so many share a band (digits taken as independent).
RECALL = 0.99
#: Prints with a group that a scan of all prints may be given whole; more are joined by shuffle.
BROADCAST_NAMED = 200_000
#: Orders rows without an id before all others.
NO_ID = -(1 << 63)


@lru_cache(1)
def _steps() -> list[list[int]]:
    """For each of 256 kinds of character and each phase, the steps until the walk moves on."""
    bits = np.random.Generator(np.random.PCG64(20240117)).integers(0, 2, (256, PERIOD))
    bits[:, 0] |= ~bits.any(1)  # a character always moves on at some phase
    return [[next(k + 1 for k in range(PERIOD) if row[(p + k) % PERIOD]) for p in range(PERIOD)] for row in bits.tolist()]


@lru_cache(1)
def _places() -> list[list[int]]:
    """For each digit the increasing places that a jump hash takes: its place in a string of length L is the last below L."""
    out = []
    for k in range(DIGITS):
        key, b, j, own = int.from_bytes(hashlib.sha256(f"place {k}".encode()).digest()[:8], "big"), -1, 0, []
        while j < 1 << 40:
            b = j
            own.append(b)
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        out.append(own)
    return out


def _kind(c: str) -> int:
    o = ord(c)
    return o if o < 256 else (o * 2654435761 >> 8) & 255


class _Pairs(dict):
    """two characters' kinds -> steps of the walk over them, by the phase it begins with."""

    def __missing__(self, pair: int) -> list[int]:
        first, second = _steps()[pair & 255], _steps()[pair >> 8]
        self[pair] = out = [n + second[(p + n) % PERIOD] for p, n in enumerate(first)]
        return out


_PAIRS = _Pairs()


def fingerprint(text: str | None) -> str:
    """DIGITS hex digits; an empty text has zeros."""
    if not text:
        return "0" * DIGITS
    try:
        kinds = text.encode("latin-1")
    except UnicodeEncodeError:
        kinds = bytes(map(_kind, text))
    kinds += b"\0" * (len(kinds) % 2)  # the end is written too, where that makes the number even
    j, ends, table = 0, [], _PAIRS
    for pair in memoryview(kinds).cast("H"):
        j += table[pair][j % PERIOD]
        ends.append(j)
    out, known = [], {}
    for own in _places():
        place = own[bisect_left(own, j) - 1]
        digit = known.get(place)
        if digit is None:
            at = bisect_right(ends, place)
            step = ends[at - 1] if at else 0
            i = 2 * at + (step + _steps()[kinds[2 * at]][step % PERIOD] <= place)
            digit = known[place] = "0123456789abcdef"[zlib.crc32(text[i : i + REACH].encode("utf-8", "surrogatepass")) * 2654435761 >> 20 & 15]
        out.append(digit)
    return "".join(out)


def likeness(a: str, b: str) -> float:
    """From 0 to 1: the share of equal digits beyond the one in 16 that unlike texts have by chance."""
    same = sum(x == y for x, y in zip(a, b, strict=True)) / DIGITS
    return max(0.0, (same - 1 / 16) / (1 - 1 / 16))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)`` of every row; a null text is empty; other columns are left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, "doc_id long, fingerprint string")


def likeness_of(a: Column, b: Column) -> Column:
    """``likeness`` by built-in functions."""
    same = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), (same / F.lit(float(DIGITS)) - 1 / 16) / (1 - 1 / 16))


def sampled_bands(n: int, threshold: float) -> list[list[int]]:
    """The digits of each band: as many a band as keep unlike prints apart among ``n``, and as many bands as RECALL asks for."""
    width = min(16, max(5, math.ceil(math.log(max(n, 2), 16))))
    share = (threshold * 15 + 1) / 16  # of digits that are equal at the threshold
    number = 1 if share >= 1 else math.ceil(math.log(1 - RECALL) / math.log(1 - share**width))
    draw = np.random.Generator(np.random.PCG64(20240118))
    return [sorted(draw.choice(DIGITS, width, replace=False).tolist()) for _ in range(number)]


def _band_cell(table: pa.Table, threshold: float, bands: list[list[int]]) -> pa.Table:
    """For each print that is linked in this cell: with how many, counted in the first band a pair shares, and an edge of a spanning star."""
    table = table.combine_chunks()
    rep, home, here = table.column("rep").to_numpy(), table.column("home").to_numpy(), table.column("k")[0].as_py()
    across = table.column("x")[0] != table.column("y")[0]
    packed = np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint8)
    digits = np.stack([packed >> 4, packed & 15], 1).reshape(-1, DIGITS)
    passes = np.array([max(0.0, (n / DIGITS - 1 / 16) / (1 - 1 / 16)) >= threshold for n in range(DIGITS + 1)])
    near, left, right = np.zeros(len(rep), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for p in range(len(rep)):
        same = digits[p + 1 :] == digits[p]
        ok = passes[same.sum(1)]
        if across:
            ok &= home[p + 1 :] != home[p]
        at = np.flatnonzero(ok)
        for band in bands[:here] if len(at) else ():
            at = at[~same[at][:, band].all(1)]
        near[p] += len(at)
        near[at + p + 1] += 1
        left.append(np.full(len(at), p))
        right.append(at + p + 1)
    a, b = np.concatenate(left), np.concatenate(right)
    pair = np.arange(len(a))
    root = spanning(np.r_[pair, pair], np.r_[a, b], rep) if len(a) else rep
    has = np.flatnonzero(near)
    return pa.table({"rep": rep[has], "near": near[has], "root": root[has]})


def similar_groups(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``prints(doc_id, fingerprint, ...)`` -> the same with ``(component_id, n_near)``.

    Distinct fingerprints that agree in one of the sampled bands are candidates,
    and all candidates of a band are verified, in tiles of a bounded size.
    ``n_near`` counts the verified candidates, other prints than its own;
    ``component_id`` is the smallest doc_id reachable.  Rows with equal prints
    are one group; rows that share a doc_id but not a print aren't, unless they
    are linked.  A row without a doc_id links nothing, and has its print's
    group if a row with an id has that print, else null.
    """
    prints = keep(prints)[0]
    digest = F.unhex("fingerprint")
    nodes = prints.groupBy(digest.alias("print")).agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).where("least is not null")
    # Numbers are fixed by being written.
    nodes = materialize(nodes.withColumn("rep", F.monotonically_increasing_id()))
    sampled = sampled_bands(nodes.count(), threshold)
    digits = lambda band: F.concat(*[F.substring(F.hex("print"), i + 1, 1) for i in band])
    # A band is dealt by a hash of its digits: bands that happen to share one are told apart no more than candidates are.
    bands = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), digits(band)).alias("band")) for k, band in enumerate(sampled)])
    dealt = nodes.select("rep", F.explode(bands).alias("b")).select("rep", "b.*").repartition("k", "band")
    tiles = F.ceil(F.col("n") / TILE).cast("int").alias("tiles")
    sizes = dealt.groupBy("k", "band").agg(F.count("*").alias("n")).where("n > 1").select("k", "band", tiles)
    # Only what shares a band gets its print.
    members = dealt.join(sizes, ["k", "band"]).join(nodes.select(F.col("rep").alias("r"), "print"), F.col("rep") == F.col("r")).drop("r")
    members = members.withColumn("home", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    cells = members.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    cells = cells.select("k", "band", F.least("home", "other").alias("x"), F.greatest("home", "other").alias("y"), "rep", "print", "home")
    found = cells.groupBy("k", "band", "x", "y").applyInArrow(lambda t: _band_cell(t, threshold, sampled), "rep long, near long, root long")
    found = materialize(found)
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    n = found.groupBy("rep").agg(F.sum("near").alias("n_near")).withColumnRenamed("rep", "x")
    named = nodes.join(n, nodes.rep == n.x, "left").join(roots, nodes.rep == roots.node, "left").where("copies > 1 or n_near is not null")
    named = named.select(F.col("print").alias("f"), "least", F.coalesce("component", "rep").alias("group"), F.coalesce("n_near", F.lit(0)).alias("near"))
    ids = named.groupBy(F.col("group").alias("g")).agg(F.min("least").alias("component"))
    named = materialize(named.join(ids, named.group == ids.g).select("f", "component", "near"))
    # Prints that are a document's own and link nothing aren't named; where few are, prints needn't be shuffled.
    out = prints.join(F.broadcast(named) if named.count() <= BROADCAST_NAMED else named, digest == named.f, "left")
    return out.select(*[prints[c] for c in prints.columns], F.coalesce("component", prints["doc_id"]).alias("component_id"), F.coalesce("near", F.lit(0)).alias("n_near"))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text beside its edited text, with both fingerprints.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next)``.  The edited text has its last ``floor(n / 2)``
    characters replaced by as many of the next document (or all), in order of id
    (rows that repeat one: of text); the last one's next is the first.  A null
    id comes first, a null text is empty.  Documents are cut by id, and where one
    has many rows by the hash of their text, into parts of about equal number
    (rows alike in both lie together); the first of each part also goes to the
    end of the part before, and each part is sorted and read in one pass.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("i"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    parts = 4 * max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("double").alias("i"))
    cuts = {(int(x), NO_ID) for x in known.approxQuantile("i", [k / parts for k in range(1, parts)], 0.25 / parts)}
    # An id of many rows, or the missing one, is cut further by the hash that orders its rows; there are fewer such than parts.
    counts = d.groupBy("i").agg(F.count("*").alias("n"))
    some = max(1, d.count() // parts)
    for i, n in counts.where(F.col("n") > 2 * some).collect():
        cuts |= {(i, NO_ID + k * (2**64 // (n // some + 1))) for k in range(n // some + 1)}
    cuts = sorted(cuts)
    ids_cut, ties_cut = (np.array(c, np.int64) for c in (zip(*cuts, strict=True) if cuts else ((), ())))

    def part(i: np.ndarray, tie: np.ndarray) -> np.ndarray:
        """How many cuts come at or before each (i, tie)."""
        low, high = np.searchsorted(ids_cut, i, "left"), np.searchsorted(ids_cut, i, "right")
        out = low.copy()
        for k in np.unique(low[high > low]):
            own = (low == k) & (high > low)
            out[own] += np.searchsorted(ties_cut[k : high[own][0]], tie[own], "right")
        return out.astype("int32")

    @F.pandas_udf("int")
    def part_of(i: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(part(i.to_numpy(), tie.to_numpy()))

    d = d.withColumn("tie", F.xxhash64("text"))
    heads = d.select(part_of("i", "tie").alias("part"), "i", "tie").groupBy("part").agg(F.min(F.struct("i", "tie")).alias("h"))
    heads = sorted((r["part"], r["i"], r["tie"]) for r in heads.select("part", "h.*").collect())  # a row a part
    # The first document of a part also closes the part before; that of the first part closes the last.
    closes = {(i, tie): heads[k - 1][0] for k, (_, i, tie) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def parts_of(i: pd.Series, tie: pd.Series) -> pd.Series:
        own = part(i.to_numpy(), tie.to_numpy()).tolist()
        return pd.Series([[p, closes[k]] if (k := (x, t)) in closes else [p] for p, x, t in zip(own, i.tolist(), tie.tolist(), strict=True)])

    d = d.select("i", "doc_id", "text", "tie", F.posexplode(parts_of("i", "tie")).alias("guard", "part"))
    dealt = d.repartition(parts, "part").sortWithinPartitions("part", "guard", "i", "tie").select("part", "guard", "doc_id", "text")

    def row(doc, text: str, own: str, after: str, next_print: str) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        e = fingerprint(edited)
        return (doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, e, likeness(own, e), likeness(own, next_print))

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            rows = []
            for p, guard, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                text = text.as_py()
                own = fingerprint(text)
                if held is not None and held[0] == p:
                    rows.append(row(held[1], held[2], held[3], text, own))
                held = None if guard else (p, doc, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return dealt.mapInArrow(each, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
