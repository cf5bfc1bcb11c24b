"""The index kept current from a stream of note events.

The index's table ``seen(path, seq, deleted, mtime)`` is the state: for each path
that ever had an event, deleted ones too, the last event that was applied.  An
event that isn't newer than that of its path is dropped in whatever batch it
comes, so the index doesn't depend on how a log is cut and in what order its
parts arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions import vectors as V
from ..operators.index import index_changes
from ..operators.postings import freq_of, postings, weights
from ..shared import remove
from ..sources.notes import read_index

#: Batches after which the index is written whole again.
FOLD = 64
EVENTS = "seq bigint, path string, text string, mtime timestamp, deleted boolean"


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path; events without a path or a number are left out.  Of several with one number a deletion, then the greatest text."""
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq"), F.desc_nulls_last("deleted"), F.desc("text")))
    return events.where("path is not null and seq is not null").withColumn("__r", last).where("__r = 1").drop("__r")


def newer(events: DataFrame, seen: DataFrame | None, late: str | None = None) -> DataFrame:
    """Those of a batch's last events that are newer than what their path has seen, and not older than the watermark."""
    own = latest(events)
    if seen is None:
        return own
    known = seen.select(F.col("path").alias("__p"), F.col("seq").alias("__s"))
    own = own.join(known, F.col("path") == F.col("__p"), "left").where("__s is null or seq > __s").drop("__p", "__s")
    if late:
        newest = F.broadcast(seen.agg(F.max("mtime").alias("__newest")))  # one row
        own = own.crossJoin(newest).where(F.coalesce(F.col("mtime") >= F.col("__newest") - F.expr(f"interval {late}"), F.lit(True))).drop("__newest")
    return own


def changes(events: DataFrame, previous: dict[str, DataFrame], chunker, embedder: V.Embedder | None, now, checkpoint, late: str | None = None) -> dict[str, DataFrame]:
    """What a batch of events changes: ``gone`` paths, new rows of notes, chunks, emb, postings and seen, and ``df`` and ``weights`` as signed numbers.

    Deleted notes vanish, written ones are chunked anew where their content
    differs.  Only notes with an event are held against the index.
    """
    events = checkpoint(newer(events, previous.get("seen"), late))
    written = events.where("not coalesce(deleted, false)").select("path", "text", "mtime", F.length("text").cast("long").alias("size"))
    touched = {t: checkpoint(previous[t].join(events.select("path"), "path", "left_semi")) for t in ("notes", "chunks")}
    known = touched["notes"].join(written.select("path"), "path", "left_semi")
    new = index_changes(written, {"notes": known, "emb": previous["emb"]}, chunker, embedder, now, checkpoint)
    gone = checkpoint(new["gone"].union(events.where("deleted").select("path")))
    own = checkpoint(postings(new["chunks"]))
    lost = weights(postings(touched["chunks"].join(gone, "path", "left_semi"))).withColumn("n", -F.col("n"))
    classes = checkpoint(summed(weights(own).union(lost), "term", "cls"))
    seen = events.select("path", "seq", F.coalesce("deleted", F.lit(False)).alias("deleted"), "mtime")
    return {**new, "gone": gone, "postings": own, "weights": classes, "df": summed(freq_of(classes)), "seen": seen}


def summed(df: DataFrame, *key: str) -> DataFrame:
    """Signed numbers added up by term (and class); those that no chunk has any more go."""
    return df.groupBy(*(key or ("term",))).agg(F.sum("n").alias("n")).where("n <> 0")


def last_seen(seen: DataFrame) -> DataFrame:
    """The last event of each path."""
    last = F.max(F.struct("seq", "deleted", "mtime")).alias("last")
    return seen.groupBy("path").agg(last).select("path", "last.seq", "last.deleted", "last.mtime")


def without_old(seen: DataFrame, late: str) -> DataFrame:
    """Deletions before the watermark are forgotten: what is older than it is dropped anyway."""
    newest = F.broadcast(seen.agg(F.max("mtime").alias("__newest")))  # one row
    old = F.col("deleted") & (F.col("mtime") < F.col("__newest") - F.expr(f"interval {late}"))
    return seen.crossJoin(newest).where(~F.coalesce(old, F.lit(False))).drop("__newest")


def refresh(events: DataFrame, previous: dict[str, DataFrame], chunker, embedder: V.Embedder | None, now, checkpoint) -> dict[str, DataFrame]:
    """The whole index after a batch of events."""
    new = changes(events, previous, chunker, embedder, now, checkpoint)
    rows = {t: previous[t].join(new["gone"], "path", "left_anti").unionByName(new[t]) for t in ("notes", "chunks", "postings") if t in previous}
    added = {t: summed(previous[t].union(new[t]), *key) for t, key in (("df", ("term",)), ("weights", ("term", "cls"))) if t in previous}
    seen = last_seen(previous["seen"].unionByName(new["seen"])) if "seen" in previous else new["seen"]
    return {**new, **rows, **added, "emb": previous["emb"].union(new["emb"]), "seen": seen}


def _whole(folder: str, batch: int) -> str:
    return f"{folder}/{batch}" if batch < 0 else f"{folder}/{batch}-whole"


def current_index(spark: SparkSession, folder: str, batch: int, fold: int = FOLD) -> dict[str, DataFrame]:
    """The index after ``batch``: the last one written whole, with the changes of the batches since."""
    return _merged(spark, folder, (batch + 1) // fold * fold - 1, batch)


def _merged(spark: SparkSession, folder: str, base: int, batch: int) -> dict[str, DataFrame]:
    index = read_index(spark, _whole(folder, base))
    since = range(base + 1, batch + 1)
    if not since:
        return index

    def log(table: str, kind: str) -> DataFrame:
        rows = spark.read.schema(kind).parquet(*[f"{folder}/{b}/{table}" for b in since])
        return rows.withColumn("__b", F.regexp_extract("_metadata.file_path", rf"/(\d+)/{table}/[^/]+$", 1).cast("int"))

    # A row holds until a later batch says that its path is gone.
    gone = log("gone", "path string").groupBy(F.col("path").alias("p")).agg(F.max("__b").alias("last"))
    out = {}
    for table in ("notes", "chunks", "postings"):
        if table in index:
            rows = index[table].withColumn("__b", F.lit(base)).unionByName(log(table, schema.INDEX[table]))
            out[table] = rows.join(gone, (F.col("path") == F.col("p")) & (F.col("last") > F.col("__b")), "left_anti").drop("__b")
    for table, key in (("df", ("term",)), ("weights", ("term", "cls"))):
        if table in index:
            out[table] = summed(index[table].union(log(table, schema.INDEX[table]).drop("__b")), *key)
    out["emb"] = index["emb"].union(log("emb", schema.EMBEDDINGS).drop("__b"))
    seen = log("seen", schema.SEEN).drop("__b")
    out["seen"] = last_seen(index["seen"].unionByName(seen) if "seen" in index else seen)
    return out


def stream_index(events: DataFrame, folder: str, write: Callable[[dict[str, DataFrame], str], None], chunker, embedder: V.Embedder | None, now, checkpoint, checkpoint_location: str, fold: int = FOLD, trigger: dict | None = None, late: str | None = None):
    """A query that applies each micro-batch of ``events`` (see EVENTS) to the index below ``folder``.

    The index before the first batch lies in the folder ``-1``.  A batch writes
    what it changes to its own folder, from the index of the batch before, so a
    repeated batch gives the same; ``current_index`` puts them together.  Every
    ``fold`` batches the index is written whole, and the folders that it and the
    whole one before make needless are removed.  An index that was written
    without postings is kept without them.  ``late``, an interval such as ``7
    days``: events whose ``mtime`` is that much older than the newest seen before
    are dropped, and deletions as old are forgotten when the index is written
    whole; without it every path's last event is kept for good.  ``trigger`` takes the arguments
    of the writer's trigger, all that is there and then the end by default.
    """
    spark = events.sparkSession

    def apply(batch: DataFrame, batch_id: int) -> None:
        previous = current_index(spark, folder, batch_id - 1, fold)
        write(changes(batch, previous, chunker, embedder, now, checkpoint, late), f"{folder}/{batch_id}")
        if (batch_id + 1) % fold == 0:
            merged = _merged(spark, folder, batch_id - fold, batch_id)
            write({**merged, "seen": without_old(merged["seen"], late)} if late else merged, _whole(folder, batch_id))
            for b in range(max(0, batch_id - 2 * fold + 1), batch_id - fold + 1):
                remove(spark, f"{folder}/{b}")
            if batch_id >= 2 * fold:  # the folder -1 isn't the stream's
                remove(spark, _whole(folder, batch_id - 2 * fold))

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_location).trigger(**(trigger or {"availableNow": True})).start()
