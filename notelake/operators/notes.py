"""Listing, filtering and describing notes; edits in bulk."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as T
from .retrieval import holding


#: Additions to a note that are put together at once.
PART = 1000


def list_notes(notes: DataFrame, folder: str | None = None, tag: str | None = None, limit: int | None = None) -> DataFrame:
    """Paths in order, of a folder (and those below it), with a tag, at most ``limit``; all by default."""
    out = notes
    if folder:
        out = out.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    if tag:
        out = out.where(F.array_contains(T.tags(F.col("text")), tag))
    out = out.select("path")
    return out.orderBy("path").limit(limit) if limit else out


def list_folders(notes: DataFrame) -> DataFrame:
    return notes.select(T.folder(F.col("path")).alias("folder")).where("folder <> ''").distinct()


def list_tags(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode(T.tags(F.col("text"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def note_metadata(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, size, mtime (19 characters), front (a map of the front matter), tags, backlinks (links from other notes, 0 where none)."""
    incoming = edges.groupBy("dst").agg(F.count("*").alias("backlinks"))
    own = notes.select("path", F.length("text").cast("long").alias("size"), F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss").alias("mtime"), T.front_matter(F.col("text")).alias("front"), F.array_join(T.tags(F.col("text")), ",").alias("tags"))
    return own.join(incoming, own.path == incoming.dst, "left").drop("dst").fillna(0, ["backlinks"])


def search_names(notes: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """For each query the first ``limit`` paths that contain it, whatever its case; an empty query finds none."""
    hits = holding(notes.select("path", F.lower("path").alias("low")), queries.select("qid", F.lower("query").alias("q")))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("path"))
    return hits.select("qid", "path", rank.alias("rank")).where(F.col("rank") <= limit)


def vault_inventory(raw: DataFrame) -> DataFrame:
    """Documents and bytes by kind (block, system, tombstone, live, other) and, for live ones, extension."""
    kind = (
        F.when(F.col("_id").startswith("h:"), "block").when(F.col("_id").startswith("_"), "system")
        .when(F.coalesce("deleted", F.lit(False)), "tombstone").when(F.coalesce("path", F.lit("")) != "", "live").otherwise("other")
    )
    ext = F.when(kind == "live", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))).otherwise("")
    return raw.groupBy(kind.alias("kind"), ext.alias("extension")).agg(F.count("*").alias("n"), F.sum(F.coalesce("size", F.lit(0))).cast("long").alias("bytes"))


def note_blocks(raw: DataFrame) -> DataFrame:
    """``(path, blocks, missing)`` of each live file: the distinct blocks that its ``children`` name, and how many of them are no document.

    Null children are none; files that share a path count together.
    """
    mine = ~F.col("_id").startswith("h:") & ~F.col("_id").startswith("_")
    alive = raw.where(mine & (F.coalesce("path", F.lit("")) != "") & ~F.coalesce("deleted", F.lit(False)))
    # A pair once, so that a block which very many files share is counted, not carried.
    pairs = alive.select("path", F.explode_outer("children").alias("child")).distinct()
    there = raw.where(F.col("_id").startswith("h:")).select(F.col("_id").alias("b")).distinct()
    both = pairs.join(there, F.col("child") == F.col("b"), "left")
    return both.groupBy("path").agg(F.count("child").alias("blocks"), F.count_if(F.col("child").isNotNull() & F.col("b").isNull()).alias("missing"))


def apply_edits(notes: DataFrame, ops: DataFrame) -> DataFrame:
    """``notes(path, text)`` after ``ops(seq, path, op, content, old_text)``: write, delete, append, prepend, replace, in order of seq.

    What comes before a path's last write or delete is dead and dropped first.
    ``replace`` changes the first occurrence of ``old_text``, none if there is none;
    an append or prepend to a missing note creates it, a replace there does nothing.
    Additions between two other ops are put together in parts of PART before they
    meet the text, so no row holds a path's ops one by one.  Other ops do nothing.
    """
    last = Window.partitionBy("path")
    resets = F.max(F.when(F.col("op").isin("write", "delete"), F.col("seq"))).over(last)
    live = ops.where("op in ('write', 'delete', 'append', 'prepend', 'replace')").withColumn("reset", resets).where("reset is null or seq >= reset")
    barrier = F.col("op").isin("write", "delete", "replace")
    live = live.withColumn("run", F.sum(F.when(barrier, 1).otherwise(0)).over(last.orderBy("seq")))
    live = live.withColumn("part", F.floor(F.row_number().over(Window.partitionBy("path", "run").orderBy("seq")) / PART))
    said = F.struct("seq", F.coalesce("content", F.lit("")).alias("content"))
    listed = lambda op, up: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("op") == op, said)), up), lambda x: x["content"]), "")
    # A run of additions is what comes before and what comes after: made in parts, then of the parts.
    start = F.max(F.when(barrier, F.struct("op", F.coalesce("content", F.lit("")).alias("content"), "old_text"))).alias("start")
    parts = live.groupBy("path", "run", "part").agg(start, listed("prepend", False).alias("before"), listed("append", True).alias("after"), F.max(~barrier).alias("adds"))
    joined = lambda c, up: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", F.col(c).alias("x"))), up), lambda p: p["x"]), "")
    runs = parts.groupBy("path", "run").agg(F.max("start").alias("start"), joined("before", False).alias("before"), joined("after", True).alias("after"), F.max("adds").alias("adds"))
    folded = runs.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("run", "start", "before", "after", "adds"))).alias("runs"))
    # One side may lack the path: a missing note is a null text.
    both = notes.select("path", "text").join(folded.withColumnRenamed("path", "p"), F.col("path") == F.col("p"), "full_outer")

    def step(text, r):
        op, c, old = r["start"]["op"], r["start"]["content"], r["start"]["old_text"]
        at = F.instr(text, old)
        replaced = F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), c, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)
        begun = F.when(op == "write", c).when(op == "delete", F.lit(None).cast("string")).when((op == "replace") & (F.length(old) > 0), replaced).otherwise(text)
        return F.when(r["adds"], F.concat(r["before"], F.coalesce(begun, F.lit("")), r["after"])).otherwise(begun)

    text = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.aggregate("runs", F.col("text"), step))
    return both.select(F.coalesce("path", "p").alias("path"), text.alias("text")).where("text is not null")


_CHANGE = "path string, since long, origin string, born long"


def note_intervals(notes: DataFrame, ops: DataFrame) -> DataFrame:
    """``(path, since, origin, born)``: from ``since`` on the note at ``path`` is the one that began at ``origin`` at ``born``.

    Only moves that take place make rows: the note must be there and its target
    free at that moment.  Whether a note is there hangs on the other ops of its
    path and on the moves before, so the paths that moves link are replayed
    together, without texts, and of a path's ops only the last before each move.
    """
    moves = ops.where("op = 'move' and path is not null and to_path is not null and path <> to_path").select("seq", "path", "to_path")
    linked = shared.connected_components(moves.select(F.col("path").alias("a"), F.col("to_path").alias("b")))
    group = linked.union(linked.select("component", "component").distinct()).select(F.col("node").alias("p"), "component")
    group = shared.materialize(group)
    touched = moves.select("seq", "path", F.lit("move").alias("kind"), "to_path").union(moves.select("seq", "to_path", F.lit("target"), F.lit(None).cast("string")))
    kind = F.when(F.col("op") == "delete", "gone").otherwise("there")
    none = F.lit(None).cast("string").alias("to_path")
    own = ops.where("op in ('write', 'delete', 'append', 'prepend')").select("seq", "path", kind.alias("kind"), none)
    first = notes.select(F.lit(-1).cast("long").alias("seq"), "path", F.lit("there").alias("kind"), none)
    every = touched.union(own.union(first).join(group, F.col("path") == F.col("p"), "left_semi"))
    after = F.lead("kind").over(Window.partitionBy("path").orderBy("seq"))
    every = every.withColumn("next", after).where("kind = 'move' or kind in ('there', 'gone') and next in ('move', 'target')")
    told = every.join(group, F.col("path") == F.col("p")).select("component", "seq", "path", "kind", "to_path")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, there, slot = None, set(), {}
        for b in batches:
            out = []
            for component, seq, path, kind, to in zip(*(b.column(c).to_pylist() for c in ("component", "seq", "path", "kind", "to_path")), strict=True):
                if component != group:
                    group, there, slot = component, set(), {}
                if kind == "there":
                    there.add(path)
                elif kind == "gone":
                    there.discard(path)
                elif path in there and to not in there:
                    there.discard(path)
                    there.add(to)
                    slot[to], slot[path] = slot.get(path, (path, -1)), (path, seq)
                    out += [(p, seq, *slot[p]) for p in (to, path)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["path", "since", "origin", "born"])

    # Groups pass by in order, a batch at a time: a task holds a group's paths, not its ops.
    return told.repartition("component").sortWithinPartitions("component", "seq").mapInArrow(replay, _CHANGE)


def apply_log(notes: DataFrame, ops: DataFrame) -> DataFrame:
    """``notes(path, text)`` after ``ops(seq, path, op, content, old_text, to_path)``, moves among them, in order of seq.

    What each op does is as in ``apply_edits``; a move takes a note to
    ``to_path``, and does nothing where the note isn't there, ``to_path`` is null or its own, or a
    note is there already.  Later ops at the old path make a new note.  Numbers
    are unique and not negative; ops without a path or number do nothing.  Each
    op is given to the note that its path was at that moment, and notes are then
    folded each by itself.
    """
    ops = ops.where("path is not null and seq is not null")
    changes = shared.materialize(note_intervals(notes, ops))
    edits = ops.where("op <> 'move'").select("seq", "path", "op", "content", "old_text")
    key = lambda origin, born: F.concat(origin, F.lit("\0"), F.coalesce(born, F.lit(-1)).cast("string"))
    starts = changes.select(F.col("since").alias("seq"), "path", F.struct("origin", "born").alias("note"))
    both = edits.unionByName(starts, allowMissingColumns=True)
    was = F.last("note", ignorenulls=True).over(Window.partitionBy("path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    own = both.withColumn("was", was).where("note is null")
    own = own.withColumn("path", key(F.coalesce("was.origin", "path"), F.col("was.born"))).drop("was", "note")
    folded = apply_edits(notes.select(key(F.col("path"), F.lit(-1)).alias("path"), "text"), own)
    # Where a note is in the end: at its last place, or where it began.
    ends = changes.groupBy(key(F.col("origin"), F.col("born")).alias("k")).agg(F.max_by("path", "since").alias("end"))
    at = folded.join(ends, folded.path == ends.k, "left")
    return at.select(F.coalesce("end", F.split_part("path", F.lit("\0"), F.lit(1))).alias("path"), "text")


def move_notes(notes: DataFrame, moves: DataFrame) -> DataFrame:
    """Notes under their new paths, ``moves(path, to_path)``; the smallest target of a path that has several.

    A target that several notes want, or that a note has which stays, is
    refused: those notes keep their paths, and so refuse who wants these.  Notes
    that move round in a circle all move.  Paths of notes are unique.
    """
    wanted = moves.join(notes.select("path"), "path", "left_semi").groupBy("path").agg(F.min("to_path").alias("to")).where("to <> path")
    refused = refused_moves(wanted, notes.select("path")).select(F.col("path").alias("source"))
    going = wanted.join(refused, wanted.path == refused.source, "left_anti").select(F.col("path").alias("source"), "to")
    # Texts meet the moves once, by their own path.
    return notes.join(going, notes.path == going.source, "left").drop("source").withColumn("path", F.coalesce("to", "path")).drop("to")


def refused_moves(wanted: DataFrame, paths: DataFrame) -> DataFrame:
    """``(path)`` of ``wanted(path, to)`` that can't move, among notes at ``paths(path)``.

    Uncontested moves form chains: each waits for the note at its target.  The
    end of every chain is found by doubling the step, in a number of rounds that
    is the logarithm of the longest chain.
    """
    crowd = wanted.groupBy("to").agg(F.count("*").alias("n")).where("n > 1").select("to")
    movers = wanted.join(crowd, "to", "left_anti")
    occupied = paths.join(movers.select("path"), "path", "left_anti").select(F.col("path").alias("taken"))
    start = movers.join(occupied, movers["to"] == occupied.taken, "left")
    spark, folder, left = wanted.sparkSession, None, None
    chain = start.select("path", F.col("to").alias("next"), F.col("taken").isNotNull().alias("refused"))
    while True:
        state, after = shared.keep(chain)
        if folder:
            shared.remove(spark, folder)
        folder, before = after, left
        left = state.where("not refused and next is not null").count()
        if not left or left == before:  # what still goes on goes in circles
            return wanted.join(crowd, "to", "left_semi").select("path").union(state.where("refused").select("path"))
        ahead = state.select(F.col("path").alias("p"), F.col("next").alias("beyond"), F.col("refused").alias("stops"))
        joined = state.join(ahead, state.next == ahead.p, "left")
        stopped = F.col("refused") | F.coalesce("stops", F.lit(False))
        chain = joined.select("path", F.when(~stopped, F.col("beyond")).alias("next"), stopped.alias("refused"))
