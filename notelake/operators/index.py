"""The incremental index: what changed, embeddings by content, chunks replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from .postings import freq_of, postings, weights
from .snapshots import UNREADABLE

#: Paths that are broadcast, at most.
FEW_PATHS = 1 << 18


def diff_notes(notes: DataFrame, index_notes: DataFrame, force: bool = False) -> DataFrame:
    """``(path, hash, status)``: new, changed, same or failed; by content alone.  Texts stay out of the join."""
    own = notes.select("path", T.content_hash(F.col("text")).alias("hash"), (F.col("text").isNull() | F.col("text").startswith(UNREADABLE)).alias("bad"))
    old = index_notes.select(F.col("path").alias("p"), F.col("hash").alias("was"))
    status = F.when(F.col("bad"), "failed").when(F.col("p").isNull(), "new").when((F.col("hash") != F.col("was")) | F.lit(force), "changed").otherwise("same")
    return own.join(old, own.path == old.p, "left").select("path", "hash", status.alias("status"))


def stale_notes(notes: DataFrame, index_notes: DataFrame) -> DataFrame:
    """Paths of the index that are gone; a note that can't be read is not gone."""
    return index_notes.select("path").join(notes.select("path"), "path", "left_anti")


def embed_missing(df: DataFrame, text: str, cache: DataFrame, embedder: V.Embedder | None, checkpoint=lambda df: df, kept: bool = True) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``vec``, and ``(h, vec)`` of the distinct texts that the cache lacked; null vectors without a model."""
    keyed = df.withColumn("__h", T.content_hash(F.col(text)))
    if embedder is None:
        return keyed.drop("__h").withColumn("vec", F.lit(None).cast("array<float>")), cache.limit(0)
    wanted = keyed.select(F.col("__h").alias("h"), F.col(text).alias("t")).dropDuplicates(["h"])
    fresh = checkpoint(V.embed(wanted.join(cache, "h", "left_anti"), embedder, "h", "t"))
    # Of a cache that is larger than what is wanted, only the vectors in use go on; what isn't kept would be made again to see which.
    # A text has one vector, so a reader without need of vectors makes no join.
    used = cache.join(wanted.select("h"), "h", "left_semi").union(fresh) if kept else cache.union(fresh).groupBy("h").agg(F.any_value("vec").alias("vec"))
    return keyed.join(used.withColumnRenamed("h", "__k"), F.col("__h") == F.col("__k"), "left").drop("__h", "__k"), fresh


def embed_with_cache(df: DataFrame, text: str, cache: DataFrame, embedder: V.Embedder | None) -> tuple[DataFrame, DataFrame]:
    """``df`` with ``vec`` and the cache with what was missing: each distinct text is embedded once; null vectors without a model."""
    out, fresh = embed_missing(df, text, cache, embedder)
    return out, cache.union(fresh)


def _rows_of(df: DataFrame, paths: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """The rows at ``paths``, or at none of ``others`` where these are all the rest: whichever are few are broadcast, so that texts aren't shuffled."""
    df = df.where("path is not null")
    if others is not None and others.count() <= FEW_PATHS:
        return df.join(F.broadcast(others), "path", "left_anti")
    return df.join(F.broadcast(paths) if paths.count() <= FEW_PATHS else paths, "path", "left_semi")


def _rows_without(df: DataFrame, paths: DataFrame) -> DataFrame:
    return df.join(F.broadcast(paths) if paths.count() <= FEW_PATHS else paths, "path", "left_anti")


def index_changes(notes: DataFrame, previous: dict[str, DataFrame], chunker: Callable[[DataFrame], DataFrame], embedder: V.Embedder | None, now: Column, checkpoint, force: bool = False, kept: bool = True) -> dict[str, DataFrame]:
    """What ``notes(path, text, mtime, size)`` change in an index: ``gone`` paths, then new rows of notes, chunks and emb.

    Chunks of new and changed notes are made, those of changed and vanished
    ones gone; failed notes keep theirs.  Without ``kept`` chunks are made where they are used, not kept as tables.
    """
    diff = checkpoint(diff_notes(notes, previous["notes"], force))
    redo, rest = (diff.where(f"status {is_} ('new', 'changed')").select("path") for is_ in ("in", "not in"))
    gone = redo.union(stale_notes(notes, previous["notes"]))
    work = _rows_of(notes, redo, rest).withColumn("hash", T.content_hash(F.col("text")))
    chunks = checkpoint(chunker(work)) if kept else chunker(work)
    texts = chunks.withColumn("__t", T.embed_text(F.col("path"), F.col("heading"), F.col("text")))
    vectors, fresh = embed_missing(texts, "__t", previous["emb"], embedder, checkpoint, kept)
    vectors = vectors.drop("__t").select("path", "ord", "heading", "hlevel", "ctype", "text", "vec")
    vectors = checkpoint(vectors) if kept else vectors
    n = vectors.groupBy("path").agg(F.count("*").cast("int").alias("n_chunks"))
    rows = work.join(n, "path", "left").select(
        "path", F.unix_timestamp("mtime").cast("double").alias("mtime"), F.col("size").cast("long").alias("size"), "hash",
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), now.alias("indexed_at"),
    )
    return {"gone": gone, "notes": rows, "chunks": vectors, "emb": fresh}


def build_index(notes: DataFrame, previous: dict[str, DataFrame], chunker: Callable[[DataFrame], DataFrame], embedder: V.Embedder | None, now: Column, checkpoint, force: bool = False, kept: bool = True) -> dict[str, DataFrame]:
    """The index after ``notes(path, text, mtime, size)``, which are all there are: tables notes, chunks, df, emb, postings, weights.

    Postings of chunks that stay are kept, so only new chunks are tokenised (all, if the index before had none).
    Without ``kept`` there are the tables notes, chunks and emb, of which only new embeddings are kept on disk: for a reader that
    goes over the chunks once.
    """
    new = index_changes(notes, previous, chunker, embedder, now, checkpoint, force, kept)
    gone = new["gone"] if kept else checkpoint(new["gone"])
    stay = {t: previous[t].join(gone, "path", "left_anti") if kept else _rows_without(previous[t], gone) for t in ("notes", "chunks", "postings") if t in previous and (kept or t != "postings")}
    chunks = stay["chunks"].unionByName(new["chunks"])
    out = {"notes": stay["notes"].unionByName(new["notes"]), "chunks": chunks, "emb": previous["emb"].union(new["emb"])}
    if not kept:
        return out
    own = stay["postings"].unionByName(postings(new["chunks"])) if "postings" in stay else postings(chunks)
    own = checkpoint(own)
    classes = checkpoint(weights(own))
    return out | {"df": freq_of(classes), "postings": own, "weights": classes}


def build_line(diff: DataFrame) -> DataFrame:
    """One row: vault, same, changed (new ones too), failed."""
    is_ = lambda *s: F.count_if(F.col("status").isin(*s))
    return diff.agg(F.count("*").alias("vault"), is_("same").alias("same"), is_("new", "changed").alias("changed"), is_("failed").alias("failed"))


def index_status(index: dict[str, DataFrame]) -> DataFrame:
    """One row: notes, chunks, chunks with a vector, when it was last indexed."""
    notes = index["notes"].agg(F.count("*").alias("notes"), F.max("indexed_at").alias("last_indexed"))
    return notes.crossJoin(index["chunks"].agg(F.count("*").alias("chunks"), F.count("vec").alias("with_vector")))
