"""The graph of wikilinks: edges, what is broken, degrees, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import shared
from ..functions import text as T

LINK = r"\[\[([^\]|#]+)"
#: Targets that only look like links.
NO_LINK = r"^(https?|ftp)://|^name:\s|^url:\s|^note$|^link$|^\*|^//|^\[|^:\w+:$|^\d+$|^-$"
ROOT = "(raíz)"


def note_bodies(chunks: DataFrame) -> DataFrame:
    """Note texts rebuilt from their chunks."""
    parts = chunks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("parts"))
    return parts.select("path", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def raw_links(notes: DataFrame) -> DataFrame:
    """``(path, target)``, a row an occurrence, whatever the target looks like."""
    found = notes.select("path", F.explode(F.regexp_extract_all("text", F.lit(LINK), F.lit(1))).alias("target"))
    return found.withColumn("target", T.strip(F.col("target"))).where("target <> ''")


def extract_links(notes: DataFrame) -> DataFrame:
    return raw_links(notes).where(~F.col("target").rlike(NO_LINK))


def _key(target: Column, compat: bool) -> Column:
    return F.regexp_replace(F.lower(target), r"[.md]+$" if compat else r"\.md$", "")


def _candidates(notes: DataFrame, links: DataFrame, compat: bool) -> DataFrame:
    """Per link occurrence: its first candidate in order of path, and how many there are."""
    links = links.withColumn("id", F.monotonically_increasing_id()).withColumn("key", _key(F.col("target"), compat))
    keys = links.select("key").distinct()
    full = F.regexp_replace(F.lower("path"), r"\.md$", "")
    names = notes.select(F.col("path").alias("to"), F.explode(F.array_distinct(F.array(T.base_name(F.col("path")), full))).alias("key"))
    # Per distinct target, so that a popular note's name is met once, not once a link.
    found = keys.join(names, "key").groupBy("key").agg(F.min("to").alias("dst"), F.countDistinct("to").alias("n"))
    return links.join(found, "key", "left").drop("id", "key")


def resolve_links(notes: DataFrame, compat: bool = False) -> DataFrame:
    """Distinct ``(src, dst)``: a target is a note's name or path; of several the first by path; a note's links to itself don't count."""
    found = _candidates(notes, extract_links(notes), compat).where("dst is not null and dst <> path")
    return found.select(F.col("path").alias("src"), "dst").distinct()


def broken_links(notes: DataFrame, compat: bool = False) -> DataFrame:
    """A row for each occurrence without a note."""
    return _candidates(notes, extract_links(notes), compat).where("dst is null").select("path", "target")


def ambiguous_links(notes: DataFrame, compat: bool = False) -> DataFrame:
    """A row for each occurrence with several notes, and their number."""
    return _candidates(notes, extract_links(notes), compat).where("n > 1").select("path", "target", "n")


def degrees(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, n_out, n_in)``, zeros included."""
    ends = edges.select(F.col("src").alias("p"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    sums = ends.groupBy("p").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    return notes.select("path").join(sums, F.col("path") == F.col("p"), "left").drop("p").fillna(0, ["n_out", "n_in"])


def orphans(degree: DataFrame) -> DataFrame:
    return degree.where("n_out = 0").select("path")


def islands(degree: DataFrame) -> DataFrame:
    return degree.where("n_out = 0 and n_in = 0").select("path")


def leaves(degree: DataFrame) -> DataFrame:
    return degree.where("n_in = 0").select("path")


def connected_components(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(path, component)``: the smallest path that a note reaches, links taken both ways."""
    roots = shared.connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return notes.select("path").join(roots, F.col("path") == F.col("node"), "left").select("path", F.coalesce("component", "path").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    """Components with their size; the component is its smallest path."""
    return components.groupBy("component").agg(F.count("*").alias("n"))


def graph_stats(degree: DataFrame, edges: DataFrame, broken: DataFrame, components: DataFrame) -> DataFrame:
    """One row: notes, linking, pct_linking, receiving, orphans, islands, components, edges, broken."""
    d = degree.agg(
        F.count("*").alias("notes"), F.count_if(F.col("n_out") > 0).alias("linking"), F.count_if(F.col("n_in") > 0).alias("receiving"),
        F.count_if(F.col("n_out") == 0).alias("orphans"), F.count_if((F.col("n_out") == 0) & (F.col("n_in") == 0)).alias("islands"),
    )
    one = [components.agg(F.countDistinct("component").alias("components")), edges.agg(F.count("*").alias("edges")), broken.agg(F.count("*").alias("broken"))]
    for x in one:  # a row each
        d = d.crossJoin(x)
    return d.withColumn("pct_linking", F.when(F.col("notes") > 0, F.floor(100 * F.col("linking") / F.col("notes"))).otherwise(0).cast("long"))


def density_by_folder(degree: DataFrame) -> DataFrame:
    """Per folder: notes, notes that link, per cent (floor), and whether that is below 20 with two notes or more."""
    own = T.folder(F.col("path"))
    per = degree.groupBy(F.when(own == "", ROOT).otherwise(own).alias("folder")).agg(F.count("*").alias("notes"), F.count_if(F.col("n_out") > 0).alias("linking"))
    pct = F.floor(100 * F.col("linking") / F.col("notes")).cast("long")
    return per.withColumn("pct", pct).withColumn("sparse", (F.col("pct") < 20) & (F.col("notes") >= 2))


def graph_health(stats: DataFrame) -> DataFrame:
    """Healthy: fewer components than half the notes, and more than half of the notes link."""
    return stats.withColumn("healthy", (F.col("components") < F.col("notes") / 2) & (F.col("linking") > F.col("notes") / 2))


def compare_graphs(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(metric, before, after)`` of two one-row statistics."""
    names = [c for c in before.columns if c != "healthy"]

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias(name)) for c in names])
        return df.select(F.explode(pairs).alias("m")).select("m.*")

    return long(before, "before").join(long(after, "after"), "metric")
