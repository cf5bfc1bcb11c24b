"""Merkle manifest of a dataset, with an authentication path for every row.

Rows are leaves; within a group (a source) they stand in order of id, and every
``FANOUT`` consecutive nodes become their hash until one is left, the group's
subroot.  The subroots, in order of group, become the root in the same way.

A group's nodes are cut into aligned blocks of ``FANOUT ** LEVELS``, each of
which a task reads in order and folds alone, so a group of any size is spread
over tasks.  The blocks' roots are nodes of the same kind, some thousand times
fewer, and are folded likewise until one a group is left.  Paths come back down
the same way: a block gets the path from its root to the top once, and a fractal
traversal of the block puts the lower part before it.  The traversal keeps, for
each level, the run of nodes that the current path goes through and the next
one, which grows by one leaf with each leaf passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

#: Nodes that become one, and levels of a block, which a task holds at once.
FANOUT, LEVELS = 16, 3
BLOCK = FANOUT**LEVELS
#: What a leaf is made of.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: One level of a path: the place in the run, and the run's other digests from left to right.
PATH = "array<struct<at:int,siblings:array<string>>>"


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(*values: Column) -> Column:
    """The hex digest of values, each written as its length in bytes, a colon and itself, or ``-`` if null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]).cast("binary"), 256)


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


class Growing:
    """A run of nodes of one level, grown leaf by leaf; below it fewer than FANOUT digests wait at each level."""

    def __init__(self, level: int) -> None:
        self.open: list[list[str]] = [[] for _ in range(level + 1)]

    def add(self, leaf: str, last: bool) -> None:
        self.open[0].append(leaf)
        for low, high in zip(self.open, self.open[1:], strict=False):
            if len(low) == FANOUT or last and low:
                high.append(digest(*low))
                low.clear()
            elif not last:
                return

    def run(self) -> list[str]:
        return self.open[-1]


def block_root(leaves: Sequence[str], levels: int) -> str:
    top = Growing(levels)
    for k, leaf in enumerate(leaves):
        top.add(leaf, k == len(leaves) - 1)
    return top.run()[0]


def traverse(leaves: Sequence[str], levels: int) -> Iterator[list[tuple[int, list[str], str]]]:
    """For each leaf of a block in turn the path to the block's root: at each level its place, the run and the siblings, joined."""
    n, spans = len(leaves), [FANOUT ** (k + 1) for k in range(levels)]  # leaves below a run

    def grown(k: int, start: int) -> list[str]:
        run = Growing(k)
        for i in range(start, min(n, start + spans[k])):
            run.add(leaves[i], i == n - 1)
        return run.run()

    existing = [grown(k, 0) for k in range(levels)]
    desired = [Growing(k) for k in range(levels)]
    joined: list[tuple[int, list[str], str] | None] = [None] * levels
    for j in range(n):
        for k in range(levels):
            at = j // FANOUT**k % FANOUT
            if joined[k] is None or j % FANOUT**k == 0:
                joined[k] = (at, existing[k], "".join(existing[k][:at] + existing[k][at + 1 :]))
        yield list(joined)
        for k in range(levels - 1):
            ahead = j + spans[k]
            if ahead < n:
                desired[k].add(leaves[ahead], ahead == n - 1)
            if (j + 1) % spans[k] == 0:
                existing[k], desired[k] = desired[k].run(), Growing(k)


def pack(path: list[tuple[int, list[str]]]) -> bytes:
    """A path as bytes: for each level the place, the number of siblings, the siblings."""
    return b"".join(bytes((at, len(own))) + bytes.fromhex("".join(own)) for at, own in path)


def unpack(packed: bytes) -> list[tuple[int, list[str]]]:
    out, i = [], 0
    while i < len(packed):
        at, n = packed[i], packed[i + 1]
        text = packed[i + 2 : i + 2 + 32 * n].hex()
        out.append((at, [text[64 * k : 64 * k + 64] for k in range(n)]))
        i += 2 + 32 * n
    return out


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf has by its path."""
    for at, own in path:
        leaf = digest(*own[:at], leaf, *own[at:])
    return leaf


def folded(leaf: Column, path: Column) -> Column:
    """``fold`` by built-in functions; ``path`` is of type PATH."""
    before = lambda p: F.concat_ws("", F.slice(p["siblings"], F.lit(1), p["at"]))
    after = lambda p: F.concat_ws("", F.slice(p["siblings"], p["at"] + 1, F.size(p["siblings"]) + 1))
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(before(p), acc, after(p)).cast("binary"), 256))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows(key, ...)`` with ``pos``, the place among its key's rows in the given order, and ``total``, their number.

    Rows are dealt by ranges of key and order, so a key of any size is spread; only the number of
    rows of each key in each part is summed up.  Rows alike in all of it are told apart by where they
    were read.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    by = ["key", *order, "__tie"]
    dealt = materialize(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    parts = dealt.groupBy("key", part.alias("__part")).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    own = Window.partitionBy("key")
    before = F.coalesce(F.sum("n").over(own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("key").alias("__key"), "__part", (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("total"))
    named = dealt.withColumn("__p", part).join(parts, (F.col("key") == F.col("__key")) & (F.col("__p") == F.col("__part")))
    return named.select(*rows.columns, (F.col("__at") + F.col("shift")).alias("pos"), "total")


def _each_block(rows: DataFrame, flush: Callable[[list[dict]], Iterator[dict]], kind: str, columns: list[tuple[str, pa.DataType]]) -> DataFrame:
    """``rows(key, block, pos, ...)`` by block, in order of pos, a block at a time: what ``flush`` makes of it."""
    dealt = rows.repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    schema = pa.schema(columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for row in b.to_pylist():
                if held and (held[0]["key"], held[0]["block"]) != (row["key"], row["block"]):
                    yield pa.RecordBatch.from_pylist(list(flush(held)), schema)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(list(flush(held)), schema)

    return dealt.mapInArrow(each, kind)


def _hex(rows: list[dict]) -> list[str]:
    return [r["digest"].hex() for r in rows]


def rolled(nodes: DataFrame) -> DataFrame:
    """``nodes(key, pos, total, digest)`` -> the same of the blocks' roots."""

    def flush(rows: list[dict]) -> Iterator[dict]:
        total = rows[0]["total"]
        root = block_root(_hex(rows), min(LEVELS, height(total)))
        yield {"key": rows[0]["key"], "pos": rows[0]["block"], "total": -(-total // BLOCK), "digest": bytes.fromhex(root)}

    blocks = nodes.select("key", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "total", "digest")
    columns = [("key", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("digest", pa.binary())]
    return _each_block(blocks, flush, "key string, pos long, total long, digest binary", columns)


def _tower(nodes: DataFrame, most: int) -> list[DataFrame]:
    """``nodes`` and what they are rolled to, until one a key is left; each is about BLOCK times smaller than the one before."""
    out = [nodes]
    while most > 1:
        out.append(materialize(rolled(out[-1])))
        most = -(-most // BLOCK)
    return out


def _marked(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes by block, and before them what their block's root has, ``above(key, pos, path, ...)``."""
    blocks = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    mark = above.withColumnsRenamed({"pos": "block"}).withColumn("pos", F.lit(-1).cast("long"))
    return blocks.unionByName(mark, allowMissingColumns=True)


def _down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``(key, pos, path)`` of ``nodes``, from the paths of their blocks' roots."""

    def flush(rows: list[dict]) -> Iterator[dict]:
        mark, own = rows[0], rows[1:]
        digests = _hex(own)
        for row, path in zip(own, traverse(digests, min(LEVELS, height(own[0]["total"]))), strict=True):
            low = pack([(at, run[:at] + run[at + 1 :]) for at, run, _ in path])
            yield {"key": row["key"], "pos": row["pos"], "path": low + mark["path"]}

    columns = [("key", pa.string()), ("pos", pa.int64()), ("path", pa.binary())]
    return _each_block(_marked(nodes.select("key", "pos", "total", "digest"), above), flush, "key string, pos long, path binary", columns)


def manifest(docs: DataFrame, received: Column | None = None, paths: bool = False, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``, one row a row of ``docs``; with ``paths`` also ``path``.

    The leaf is ``leaf_of`` the ``columns``; ``received`` is the leaf of the row
    as it was received, where it isn't null: ``folded_root`` is folded from that
    along the path, and ``verified`` says whether it is the root.
    ``proof_sha256`` is the hash of the path's siblings.  Within a group rows
    ascend by id, a null id first; rows that share an id ascend by leaf, and
    equal rows are leaves of their own.  Null is a group, the first.  A null
    value is ``-`` in its leaf, an empty text ``0:``.  A group of one row has it
    as subroot; no rows in, no rows out.  Other columns play no part.
    """
    leaf = leaf_of(*[F.col(c) for c in columns])
    key = F.coalesce(F.concat(F.lit("1"), F.col(group_col)), F.lit("0"))
    other = F.lit(None).cast("binary") if received is None else F.unhex(received)
    leaves = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(leaf).alias("digest"), other.alias("received"))
    nodes = materialize(numbered(leaves, "doc_id", "digest"))
    most = nodes.agg(F.max("total")).first()[0] or 0
    groups = _tower(nodes, max(2, most))  # at least one above, which has a row a group
    tops = groups[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    tops = materialize(numbered(tops, "group"))
    tower = _tower(tops, tops.count())
    top = tower[-1].first()
    root = top["digest"].hex() if top else ""
    path = tower[-1].select("key", "pos", F.lit(b"").alias("path"))
    for level in reversed(tower[:-1]):
        path = materialize(_down(level, path))
    # A group's only node is its subroot.
    own = tops.withColumnRenamed("digest", "top").join(path.select(F.col("pos").alias("p"), "path"), F.col("pos") == F.col("p"))
    subroots = own.select(F.col("group").alias("g"), "top")
    path = own.select(F.col("group").alias("key"), F.lit(0).cast("long").alias("pos"), "path")
    for level in reversed(groups[1:-1]):
        path = materialize(_down(level, path))
    marks = path.join(subroots, F.col("key") == F.col("g")).drop("g")

    def flush(rows: list[dict]) -> Iterator[dict]:
        mark, mine = rows[0], rows[1:]
        upper, subroot, digests = unpack(mark["path"]), mark["top"].hex(), _hex(mine)
        rest = "".join(s for _, sibs in upper for s in sibs)
        around = [("".join(s[:at]), "".join(s[at:])) for at, s in upper]
        for row, leaf_hex, path in zip(mine, digests, traverse(digests, min(LEVELS, height(mine[0]["total"]))), strict=True):
            node = row["received"].hex() if row["received"] is not None else leaf_hex
            for at, run, text in path:
                node = digest(text[: 64 * at], node, text[64 * at :])
            for left, right in around:
                node = digest(left, node, right)
            out = {"doc_id": row["doc_id"], "leaf": leaf_hex, "subroot": subroot, "root": root, "proof_sha256": digest(*(t for _, _, t in path), rest), "folded_root": node, "verified": node == root}
            if paths:
                out["path"] = [{"at": at, "siblings": run[:at] + run[at + 1 :]} for at, run, _ in path] + [{"at": at, "siblings": s} for at, s in upper]
            yield out

    text = pa.string()
    columns_out = [("doc_id", pa.int64()), ("leaf", text), ("subroot", text), ("root", text), ("proof_sha256", text), ("folded_root", text), ("verified", pa.bool_())]
    kind = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if paths:
        columns_out.append(("path", pa.list_(pa.struct([("at", pa.int32()), ("siblings", pa.list_(text))]))))
        kind += f", path {PATH}"
    return _each_block(_marked(nodes, marks), flush, kind, columns_out)


def with_changed_case(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", every: int = 5) -> Column:
    """The leaf of rows whose text was lower-cased (A-Z) on the way: those where ``every`` divides the CRC-32 of the decimal id."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    lowered = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(hit, leaf_of(*[lowered if c == text_col else F.col(c) for c in COLUMNS]))
