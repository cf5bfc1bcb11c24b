"""The graph of wikilinks kept current: after a change only the links, degrees and components that it touches are made anew.

A state has four tables: ``names(path, key)``, the names under which a note is
found; ``links(path, target, key, n, dst, n_dst)``, a note's links with how often
they occur, the note that they lead to and how many it could be; ``degrees(path,
n_out, n_in)``; ``components(path, component)``.  A path is a note.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as T
from . import graph

NAMES = "path string, key string"
LINKS = "path string, target string, key string, n bigint, dst string, n_dst bigint"
DEGREES = "path string, n_out bigint, n_in bigint"
COMPONENTS = "path string, component string"

#: The tables of a state.
STATE = {"names": NAMES, "links": LINKS, "degrees": DEGREES, "components": COMPONENTS}


def _names(notes: DataFrame) -> DataFrame:
    full = F.regexp_replace(F.lower("path"), r"\.md$", "")
    return notes.select("path", F.explode(F.array_distinct(F.array(T.base_name(F.col("path")), full))).alias("key"))


def _links(notes: DataFrame) -> DataFrame:
    found = graph.extract_links(notes).groupBy("path", "target").agg(F.count("*").alias("n"))
    return found.withColumn("key", F.regexp_replace(F.lower("target"), r"\.md$", "")).select("path", "target", "key", "n")


def _resolve(links: DataFrame, names: DataFrame) -> DataFrame:
    """``links(path, target, key, n)`` with dst and n_dst; a key is looked up once, however many links have it."""
    at = names.join(links.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min("path").alias("dst"), F.count("*").alias("n_dst"))
    return links.join(at, "key", "left").select("path", "target", "key", "n", "dst", F.coalesce("n_dst", F.lit(0)).alias("n_dst"))


def _edges(links: DataFrame) -> DataFrame:
    return links.where("dst is not null and dst <> path").select(F.col("path").alias("src"), "dst").distinct()


def empty(spark) -> dict[str, DataFrame]:
    return {name: spark.createDataFrame([], kind) for name, kind in STATE.items()}


def edges(state: dict[str, DataFrame]) -> DataFrame:
    """Distinct ``(src, dst)``, as ``graph.resolve_links``."""
    return _edges(state["links"])


def broken(state: dict[str, DataFrame]) -> DataFrame:
    """A row for each occurrence without a note, as ``graph.broken_links``."""
    return state["links"].where("dst is null").select("path", "target", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).drop("i")


def stats(state: dict[str, DataFrame]) -> DataFrame:
    """One row, as ``graph.graph_stats``."""
    return graph.graph_stats(state["degrees"], edges(state), broken(state), state["components"])


def graph_changes(state: dict[str, DataFrame], changes: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] = shared.materialize) -> dict[str, DataFrame]:
    """What ``changes(path, text, seq)`` change in a state; a null text takes the note away.

    Of changes of one path the last counts (the greatest seq, nulls first; then
    the greatest text, null least); a null path changes nothing.  For each table
    of a state the rows that are new, and below ``gone`` + its name the keys
    whose rows go: ``names``, ``degrees`` and ``components`` by path, ``links``
    by path and target.

    A name that appears or vanishes moves only links to it.  Of the components,
    those that lost an edge are found anew from their own notes; all others
    stand as one node each, and are merged where an edge is new.
    """
    last = changes.where("path is not null").groupBy("path").agg(F.max(F.struct("seq", "text")).alias("c")).select("path", F.col("c.text").alias("text"))
    last = checkpoint(last)
    touched, there = last.select("path"), last.where("text is not null")

    was = state["names"].join(touched, "path", "left_semi")
    now = _names(there)
    both = was.select("path", "key", F.lit(-1).alias("d")).union(now.select("path", "key", F.lit(1)))
    moved = checkpoint(both.groupBy("path", "key").agg(F.sum("d").alias("d")).where("d <> 0").select("key").distinct())

    # Links to be made: those of the notes that changed, and others' to a name that moved.
    others = state["links"].join(touched, "path", "left_anti").join(moved, "key", "left_semi")
    names = state["names"].join(touched, "path", "left_anti").unionByName(now)
    links = checkpoint(_resolve(_links(there).unionByName(others.select("path", "target", "key", "n")), names))
    before = state["links"].join(touched, "path", "left_semi").select(*links.columns).unionByName(others.select(*links.columns))
    before = checkpoint(before)

    # An edge may stand on several links, of which not all are made anew: all links of a note that has such count.
    srcs = touched.union(links.select("path")).union(before.select("path")).distinct()
    gone_links = before.select("path", "target").distinct()
    own = state["links"].join(srcs, "path", "left_semi")
    after = own.join(gone_links, ["path", "target"], "left_anti").unionByName(links.select(*own.columns))
    signed = _edges(own).withColumn("d", F.lit(-1)).union(_edges(after).withColumn("d", F.lit(1)))
    diff = checkpoint(signed.groupBy("src", "dst").agg(F.sum("d").alias("d")).where("d <> 0"))

    ends = diff.select(F.col("src").alias("path"), F.col("d").alias("o"), F.lit(0).alias("i")).union(diff.select("dst", F.lit(0), F.col("d")))
    known = state["degrees"].join(ends.select("path").union(touched).distinct(), "path", "left_semi").select("path", F.col("n_out").alias("o"), F.col("n_in").alias("i"))
    sums = known.union(ends).union(there.select("path", F.lit(0), F.lit(0))).groupBy("path").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    vanished = last.where("text is null").select("path")
    degrees = checkpoint(sums.join(vanished, "path", "left_anti"))

    comps = state["components"]
    cut = diff.where("d < 0").select(F.col("src").alias("path"))  # both ends of an edge are in one component
    dirty = checkpoint(comps.join(comps.join(cut.distinct(), "path", "left_semi").select("component").distinct(), "component", "left_semi").select("path", "component"))
    loose = checkpoint(dirty.select("path").union(there.join(comps, "path", "left_anti").select("path")))  # notes that stand for themselves
    new = diff.where("d > 0").select("src", "dst")
    kept = state["links"].join(dirty.select("path"), "path", "left_semi").join(gone_links, ["path", "target"], "left_anti")
    # Links that were made anew may lead where they led before: their edges are old ones.
    remade = links.join(dirty.select("path"), "path", "left_semi")
    old = _edges(kept.select(*links.columns).unionByName(remade)).join(new, ["src", "dst"], "left_anti")
    need = new.select(F.col("src").alias("path")).union(new.select("dst")).distinct()
    label = comps.join(need, "path", "left_semi").join(loose, "path", "left_anti").select(F.col("path").alias("p"), "component")

    def stands(df: DataFrame, end: str) -> DataFrame:
        return df.join(label, F.col(end) == F.col("p"), "left").withColumn(end, F.coalesce("component", end)).drop("p", "component")

    work = stands(stands(new, "src"), "dst").union(old).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    roots = shared.connected_components(work)
    merged = roots.select(F.col("node").alias("component"), F.col("component").alias("to"))
    whole = comps.join(loose, "path", "left_anti").join(merged, "component").select("path", F.col("to").alias("component"))
    single = loose.join(vanished, "path", "left_anti").join(roots, F.col("path") == F.col("node"), "left").select("path", F.coalesce("component", "path").alias("component"))
    components = checkpoint(whole.union(single))
    return {
        "names": now, "links": links, "degrees": degrees, "components": components,
        "gone names": touched, "gone links": gone_links,
        "gone degrees": degrees.select("path").union(vanished), "gone components": components.select("path").union(vanished),
    }


def update_graph(state: dict[str, DataFrame], changes: DataFrame, checkpoint: Callable[[DataFrame], DataFrame] = shared.materialize) -> dict[str, DataFrame]:
    """The state after ``changes``; see ``graph_changes``.  What a change doesn't touch is only read."""
    new = graph_changes(state, changes, checkpoint)
    return {
        name: state[name].join(new[f"gone {name}"], ["path", "target"] if name == "links" else "path", "left_anti").unionByName(new[name])
        for name in STATE
    }


def change_report(new: dict[str, DataFrame]) -> DataFrame:
    """``(table, rows)``: how many rows of each table a change made anew."""
    per = [new[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name in STATE]
    out = per[0]
    for more in per[1:]:
        out = out.union(more)
    return out
