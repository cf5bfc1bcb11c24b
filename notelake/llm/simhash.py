"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most ``2 r`` bits exactly when the balls
of radius ``r`` around them share a value.  So every distinct fingerprint
emits all variants within ``r`` bits, equal variants meet, and whatever meets
is linked.  The variants are not shuffled one by one (2,081 a fingerprint at
``r = 2``): variants that share their first ``b`` bits form a *cell*, a
fingerprint is sent once to each cell that holds some of its variants
(``1 + b + b (b - 1) / 2`` cells), and the cell's task expands and sorts them.
``b`` follows the number of fingerprints, so a cell's work stays the same at
any size.  A hot cell (a family of texts that agree in the first bits) is dealt
again by the bits that follow, to as many tasks as it needs; a task halves what
it expands bit by bit, which bounds its memory.  A cell returns edges that span
what it linked, not pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import connected_components, materialize

SEED = 42
_ODD, _SALTS = np.uint64(0x9E3779B97F4A7C15), np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
#: Variants of a cell, about, and those that a task holds at once.
CELL_VARIANTS, HELD_VARIANTS = 1 << 22, 1 << 20
#: Rows of a cell from which it is dealt again by so many further bits.
HOT_ROWS, SPLIT_BITS = 1 << 20, 4
#: Tasks that cells are dealt to, at most; a task takes its cells one by one.
MAX_TASKS = 1 << 14
#: Prints of a text by which near copies are looked for: at a similarity of 0.8 two of four often differ in more than
#: four bits, all of them rarely.
PRINTS = 4
#: Documents and shingles of a tile, about, in which near copies are verified.
TILE_DOCS, TILE_SHINGLES = 1 << 11, 1 << 20
#: Of pairs at a similarity of 0.8, 99.97 % share one of so many min-hashes.
MIN_HASHES = 5


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(found: list[bytes], words: int) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included; of the whole where it has fewer words."""
    n, joined = len(found), b" ".join(found)
    if n <= words:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        size = np.fromiter(map(len, found), np.int64, n)
        end = np.cumsum(size + 1) - 1
        start = (end - size)[: n - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(start, end[words - 1 :].tolist(), strict=True)]
    return np.array(hashes, "<u8")


def _majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += part.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of the word shingles of ``text``, repeats included; 0 without words."""
    found = _words(text)
    return _majority(_shingles(found, words)) if found else 0


def word_prints(found: list[bytes], prints: int = PRINTS) -> np.ndarray:
    """``prints`` 64-bit SimHashes of the single words, each by other bits of their hashes; zeros without words.

    An edit changes fewer words than longer shingles.  A word counts by the root
    of its number, lest the frequent words, which unlike texts share, decide all.
    """
    if not found:
        return np.zeros(prints, "<u8")
    count = Counter(found)
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in count), np.uint64, len(count))
    weight = np.rint(8 * np.sqrt(np.fromiter(count.values(), np.int64, len(count)))).astype(np.float32)
    h = (h[:, None] ^ _SALTS[:prints]) * _ODD
    h = ((h ^ (h >> np.uint64(32))) * _ODD).astype("<u8")
    ones = np.zeros(64 * prints)
    for at in range(0, len(h), 1 << 12):
        part = np.unpackbits(h[at : at + (1 << 12)].view(np.uint8), bitorder="little").reshape(-1, 64 * prints)
        ones += weight[at : at + (1 << 12)] @ part.astype(np.float32)
    return np.packbits(2 * ones > weight.sum(dtype=float), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp long)`` of every row; a null text counts as empty.  Other columns are left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return known.mapInArrow(each, "doc_id long, fp long")


@lru_cache(256)
def _masks(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``radius`` ones."""
    return np.array([sum(1 << i for i in c) for k in range(min(bits, radius) + 1) for c in combinations(range(bits), k)], np.uint64)


def _meet(low: np.ndarray, off: np.ndarray, who: np.ndarray, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(group, member)`` arrays of the fingerprints whose variants in this cell are equal.

    low: the bits below the cell's; off: bits that already differ from the cell's; who: what to report.
    """
    if len(low) < 2:
        return
    count = np.bincount(off, minlength=radius + 1)
    size = [sum(math.comb(bits, i) for i in range(radius - k + 1)) for k in range(radius + 1)]
    if int(np.dot(count, size)) > HELD_VARIANTS and bits > 1:
        top = np.uint64(1 << (bits - 1))
        one = (low & top) != 0
        for side in (False, True):
            k = off + (one != side)
            keep = k <= radius
            yield from _meet(low[keep] & (top - np.uint64(1)), k[keep], who[keep], bits - 1, radius)
        return
    keys, src = [], []
    for k in range(radius + 1):
        at = np.flatnonzero(off == k)
        if len(at):
            m = _masks(bits, radius - k)
            keys.append((low[at][:, None] ^ m[None, :]).ravel())
            src.append(np.repeat(who[at], len(m)))
    keys, src = np.concatenate(keys), np.concatenate(src)
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if len(twice):
        twice = np.unique(twice)
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        hit = twice[at] == keys
        yield at[hit], src[hit]


def spanning(group: np.ndarray, member: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest ``label`` that each member reaches when the members of a group are linked."""
    order = np.argsort(group, kind="stable")
    group, member = group[order], member[order]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size, label = np.diff(np.r_[start, len(group)]), label.copy()
    while True:
        least, was = np.minimum.reduceat(label[member], start), label.copy()
        np.minimum.at(label, member, np.repeat(least, size))
        if (was == label).all():
            return label


def _link_cell(table: pa.Table, radius: int) -> pa.Table:
    fp = table.column("fp").to_numpy().view(np.uint64)
    rep = table.column("rep").to_numpy()
    low_bits = 64 - table.column("depth")[0].as_py()
    cell = table.column("cell").to_numpy()[:1].view(np.uint64)[0]
    off = np.bitwise_count((fp >> np.uint64(low_bits)) ^ cell).astype(np.int64)
    low = fp & np.uint64((1 << low_bits) - 1)
    root, a, b = rep.copy(), [], []

    def note(one: np.ndarray, other: np.ndarray) -> None:
        pairs = np.unique(np.stack([one, other], 1), axis=0)
        a.append(pairs[:, 0])
        b.append(pairs[:, 1])

    # What is linked already has one root, so that a link found again costs nothing more.
    for group, member in _meet(low, off, np.arange(len(fp)), low_bits, radius):
        label = spanning(group, member, root)
        moved = np.flatnonzero(label != root)
        note(root[moved], label[moved])
        root = label
    moved = np.flatnonzero(root != rep)
    note(rep[moved], root[moved])
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})


def _dealt(nodes: DataFrame, bits: int, radius: int) -> DataFrame:
    """``nodes(k, fp, rep)`` in each cell that holds some of their variants: ``(k, depth, cell, fp, rep)``, the cell being the first ``depth`` bits.

    Each variant lies in one cell: hot cells are replaced by those of SPLIT_BITS more bits until none is hot.
    """
    masks = lambda n: ",".join(str(int(m)) for m in _masks(n, radius))
    level, depth, done = nodes.select(F.expr(f"explode(transform(array({masks(bits)}), m -> shiftrightunsigned(fp, {64 - bits}) ^ cast(m as long)))").alias("cell"), "k", "fp", "rep"), bits, []
    while depth < 64:
        hot = materialize(level.groupBy("k", "cell").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select(F.col("k").alias("hot_k"), F.col("cell").alias("hot")))
        if hot.isEmpty():
            break
        is_hot = (F.col("cell") == F.col("hot")) & (F.col("k") == F.col("hot_k"))
        done.append(level.join(hot, is_hot, "left_anti").select("k", F.lit(depth).alias("depth"), "cell", "fp", "rep"))
        step = min(SPLIT_BITS, 64 - depth)
        off = f"bit_count(cell ^ {f'shiftrightunsigned(fp, {64 - depth})' if depth < 64 else 'fp'})"
        ahead = f"shiftrightunsigned(fp, {64 - depth - step}) & {(1 << step) - 1}"
        own = F.expr(f"filter(array({masks(step)}), m -> {off} + bit_count(m) <= {radius})")
        level = level.join(hot, is_hot, "left_semi").withColumn("m", F.explode(own))
        level = level.select(F.expr(f"shiftleft(cell, {step}) | (({ahead}) ^ cast(m as long))").alias("cell"), "k", "fp", "rep")
        depth += step
    out = level.select("k", F.lit(depth).alias("depth"), "cell", "fp", "rep")
    for cold in done:
        out = out.union(cold)
    return out


def ball_links(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``nodes(k, fp, rep)``, distinct in k and fp -> edges ``(a, b)`` of reps that span all links at ``max_bits`` or fewer differing bits within a k."""
    if max_bits % 2 or not 0 <= max_bits <= 8:
        raise ValueError("max_bits must be even, from 0 to 8: the balls of half the radius meet in the middle")
    radius = max_bits // 2
    most = nodes.groupBy("k").count().agg(F.max("count"), F.count("*")).first()
    n, prints = most[0] or 0, most[1]
    variants = n * sum(math.comb(64, k) for k in range(radius + 1))
    bits = min(24, max(4, math.ceil(math.log2(max(1, variants / CELL_VARIANTS)))))
    cells = prints * 2**bits
    tasks = max(1, min(MAX_TASKS, max(cells // 4, min(cells, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))))
    dealt = _dealt(nodes, bits, radius).repartition(tasks, "k", "depth", "cell")
    return dealt.groupBy("k", "depth", "cell").applyInArrow(lambda t: _link_cell(t, radius), "a long, b long")


def near_components(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """``prints(doc_id, fp)`` -> ``(doc_id, fp, component_id)``: fingerprints link at ``max_bits`` or fewer differing bits.

    ``component_id`` is the smallest doc_id reachable.  Equal fingerprints
    (exact copies, and all texts without words) are one node, so groups of
    copies of any size cost one row here.  A row without a doc_id keeps its
    fingerprint, links nothing and gets a null component.  Rows that share an id
    but not a fingerprint are nodes of their own: their id doesn't link them.
    No rows in, no rows out.
    """
    prints = materialize(prints)
    nodes = materialize(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(ball_links(nodes.select(F.lit(0).alias("k"), "fp", F.col("fp").alias("rep")), max_bits))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select(F.col("fp").alias("f"), "least", F.coalesce("component", "fp").alias("root"))
    ids = named.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = named.join(ids, named.root == ids.r).select("f", "component_id")
    return prints.join(named, (prints.fp == named.f) & prints.doc_id.isNotNull(), "left").select("doc_id", "fp", "component_id")


def simhash_components(docs: DataFrame, words: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row a document; fingerprint in 16 lowercase hex digits.

    Whole texts, ASCII letters lower-cased, words between ASCII white space.
    Null and empty texts, and texts of white space, have fingerprint zero and
    are linked with each other like any other.
    """
    out = near_components(fingerprints(docs, words, id_col, text_col), max_bits)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _verify(table: pa.Table, threshold: float, across: bool) -> pa.Table:
    """Edges ``(a, b)`` that span what is linked: each text of a tile held against all others that it isn't yet linked with."""
    table = table.combine_chunks()
    rep, root = table.column("rep").to_numpy(), table.column("label").to_numpy().copy()
    side = table.column("tile").to_numpy() if across else None
    lists = table.column("sh").combine_chunks()
    ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
    size = lists.value_lengths().to_numpy().astype(np.int64)
    end = np.cumsum(size)
    start, mark = end - size, np.zeros(len(ids), bool)
    for p in range(len(rep)):
        free = (root != root[p]) & (size >= threshold * size[p] - 1e-9) & (size[p] >= threshold * size - 1e-9)
        if across:
            free &= side != side[p]
        free[: p + 1] = False
        at = np.flatnonzero(free)
        if not len(at):
            continue
        own = ids[start[p] : end[p]]
        mark[own] = True
        if len(at) <= 64:
            common = np.array([np.count_nonzero(mark[ids[start[q] : end[q]]]) for q in at])
        else:
            common = np.add.reduceat(mark[ids], start, dtype=np.int64)[at]
        mark[own] = False
        linked = at[common >= threshold * (size[p] + size[at] - common) - 1e-9]
        if len(linked):
            merged = np.unique(np.append(root[linked], root[p]))
            root[np.isin(root, merged)] = merged[0]
    moved = np.flatnonzero(root != rep)
    return pa.table({"a": rep[moved], "b": root[moved]})


def near_copy_links(docs: DataFrame, nodes: DataFrame, words: int, threshold: float, max_bits: int) -> DataFrame:
    """``nodes(node, doc_id, raw, fps)`` of unlike texts -> ``(node, component)`` as ``connected_components`` has it.

    What links at ``max_bits`` in one of its prints makes candidate groups.  Chains make some of them
    large, so a group is dealt by MIN_HASHES min-hashes of the shingles: a pair
    at similarity J meets at one of them with probability 1 - (1 - J)^MIN_HASHES.
    What meets is dealt to tiles of bounded size; in a tile, and against the
    first text, all that isn't linked yet is compared by its sets of shingles.
    Where several tiles are left apart, they are compared tile by tile.
    """
    own = nodes.select("node", F.posexplode("fps").alias("k", "fp"))
    prints = materialize(own.groupBy("k", "fp").agg(F.min("node").alias("rep"), F.count("*").alias("equal")))
    equal = prints.where("equal > 1").select(F.col("k").alias("q"), F.col("fp").alias("f"), "rep")
    equal = own.join(equal, (F.col("k") == F.col("q")) & (F.col("fp") == F.col("f"))).select(F.col("node").alias("a"), F.col("rep").alias("b"))
    near = connected_components(ball_links(prints.select("k", "fp", "rep"), max_bits).union(equal))
    # A component's smallest node isn't in it.
    near = near.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    near = materialize(near.union(near.select("comp", "comp").distinct()))
    odd = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 63, MIN_HASHES, np.uint64) * np.uint64(2) + np.uint64(1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sh = [np.unique(_shingles(_words(t.as_py()), words)) for t in b.column(2)]
            least = [np.array([((h ^ (h >> np.uint64(29))) * a).min() for a in odd], "<u8").view("<i8") for h in sh]
            held = [pa.array([h.view("<i8") for h in sh], pa.list_(pa.int64())), pa.array(least, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *held], ["rep", "comp", "sh", "least"])

    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("r"), "text")
    asked = near.join(nodes.select("node", "doc_id", "raw"), near.rep == F.col("node")).select("rep", "comp", "doc_id", "raw")
    texts = asked.join(texts, (F.col("doc_id") == F.col("d")) & (F.col("raw") == F.col("r"))).select("rep", "comp", "text")
    # A row that is repeated as a whole would be its node's text twice.
    held = materialize(texts.mapInArrow(each, "rep long, comp long, sh array<long>, least array<long>").dropDuplicates(["rep"]))
    keys = held.select("rep", F.size("sh").alias("n"), "comp", F.posexplode("least").alias("k", "m"))
    tiles = F.ceil(F.greatest(F.count("*") / TILE_DOCS, F.sum("n") / TILE_SHINGLES)).cast("int").alias("tiles")
    sizes = keys.groupBy("comp", "k", "m").agg(F.min("rep").alias("head"), F.count("*").alias("members"), tiles).where("members > 1")
    home = F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int").alias("home")
    dealt = materialize(keys.join(sizes, ["comp", "k", "m"]).select(F.col("rep").alias("r"), "comp", "k", "m", "head", "tiles", home))
    sets = held.select("rep", "sh")
    everywhere = F.when(F.col("r") == F.col("head"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("home"))
    cells = dealt.select("r", "comp", "k", "m", F.explode(everywhere).alias("tile"))
    cells = cells.join(sets, cells.r == sets.rep).select("comp", "k", "m", "rep", F.col("rep").alias("label"), "sh", "tile")
    links = materialize(cells.groupBy("comp", "k", "m", "tile").applyInArrow(lambda t: _verify(t, threshold, False), "a long, b long"))
    roots = connected_components(links)
    if dealt.where("tiles > 1").isEmpty():  # nothing to compare beyond
        return roots
    parts = dealt.where("tiles > 1").join(roots, F.col("r") == F.col("node"), "left")
    parts = parts.select("comp", "k", "m", "r", "tiles", "home", F.coalesce("component", "r").alias("label"))
    apart = parts.groupBy("comp", "k", "m").agg(F.min("label").alias("l"), F.max("label").alias("u")).where("l < u").select("comp", "k", "m")
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: t != F.col("home"))).alias("other")
    cells = parts.join(apart, ["comp", "k", "m"]).select("comp", "k", "m", "r", "label", F.col("home").alias("tile"), other)
    sides = [F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y")]
    cells = cells.join(sets, cells.r == sets.rep).select("comp", "k", "m", "rep", "label", "sh", "tile", *sides)
    more = cells.groupBy("comp", "k", "m", "x", "y").applyInArrow(lambda t: _verify(t, threshold, True), "a long, b long")
    return connected_components(links.union(more))


def drop_near_copies(docs: DataFrame, words: int = 5, threshold: float = 0.8, max_bits: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; columns as they came.

    Texts of the same words in order are copies.  Others are linked where the
    sets of their shingles of ``words`` words (as 64-bit hashes) have a Jaccard
    similarity of at least ``threshold``; those are looked for among texts of
    which one of the ``word_prints`` chains in steps of ``max_bits`` or fewer
    bits, and all verified.
    A null text is empty, texts without words are copies of each other, and
    texts of fewer words than ``words`` have one shingle.  Rows without a doc_id
    cannot be told apart and stay.  Rows that share a doc_id are texts of their
    own; of those that share the text too, one stays.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_words(t.as_py()) for t in b.column(2)]
            fps = pa.array([word_prints(w).view("<i8") for w in found], pa.list_(pa.int64()))
            same = pa.array([xxhash.xxh3_128_digest(b" ".join(w)) for w in found], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps, same], ["doc_id", "raw", "fps", "same"])

    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("raw"), "text")
    prints = materialize(known.mapInArrow(each, "doc_id long, raw long, fps array<long>, same binary"))
    first = prints.groupBy("same").agg(F.min(F.struct("doc_id", "raw")).alias("first"), F.first("fps").alias("fps"))
    # Numbers are fixed by being written.
    nodes = materialize(first.select(F.monotonically_increasing_id().alias("node"), "first.*", "fps"))
    roots = near_copy_links(docs, nodes, words, threshold, max_bits)
    groups = nodes.join(roots.withColumnRenamed("node", "n"), nodes.node == F.col("n"), "left").groupBy(F.coalesce("component", "node").alias("g"))
    kept = materialize(groups.agg(F.min(F.struct("doc_id", "raw")).alias("k")).select(F.col("k.doc_id").alias("__kept"), F.col("k.raw").alias("__raw")))
    out = docs.join(kept, (docs["doc_id"] == F.col("__kept")) & (F.xxhash64(docs["text"]) == F.col("__raw")), "left_semi")
    if not prints.groupBy("doc_id", "raw").count().where("count > 1").isEmpty():  # else texts needn't be shuffled for it
        own = out.withColumns({"__id": F.col("doc_id"), "__raw": F.xxhash64("text")})
        out = own.dropDuplicates(["__id", "__raw"]).drop("__id", "__raw")
    return out.unionByName(docs.where(docs["doc_id"].isNull()))
