"""The folder that all executors share, and what operators keep there while they work."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Edges that a task contracts at once.
CHUNK = 1 << 18


def shared_base(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    A session without one gets a temporary folder if its master is local (a
    test on one machine); on a cluster that is an error, as each executor would
    write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='notelake-')}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``shared_base``."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, instead_of: str | None = None) -> DataFrame:
    """Compute ``df`` once into the shared folder and read it from there, partitioned as it is.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes the
    files once nothing refers to them.  ``instead_of``: a folder that ``keep``
    named and that is removed, as ``df`` was all that was wanted of it.
    """
    shared_base(df.sparkSession)
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        df.sparkSession.sparkContext.setCheckpointDir(shared_base(df.sparkSession))
    out = df.checkpoint()
    if instead_of:
        remove(df.sparkSession, instead_of)
    return out


def keep(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, and that table's folder, to be removed by ``remove``."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, "kept")
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder), folder


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``keep`` or ``shared_folder`` named; nothing happens where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _stars(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> edges that link the same, contracted within each task: each node to the smallest it reaches there.

    A task holds CHUNK edges at once.  Roots that are linked hook to the smallest root beside them and paths are cut
    short, all at once, until nothing moves; that takes about the logarithm of the chunk's size.
    """
    kind = dict(edges.dtypes)["u"]

    def contract(u: pa.ChunkedArray, v: pa.ChunkedArray) -> pa.RecordBatch:
        coded = pa.concat_arrays([*u.chunks, *v.chunks]).dictionary_encode()
        names = coded.dictionary
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        ends = rank[coded.indices.to_numpy()]
        a, b, root = ends[: len(u)], ends[len(u) :], np.arange(len(order))
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != (short := root[root])).any():
                root = short
        moved = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(order[moved])), names.take(pa.array(order[root[moved]]))], ["u", "v"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= CHUNK:
                t = pa.Table.from_batches(held)
                yield contract(t.column(0), t.column(1))
                held, n = [], 0
        if n:
            t = pa.Table.from_batches(held)
            yield contract(t.column(0), t.column(1))

    return edges.select("u", "v").mapInArrow(each, f"u {kind}, v {kind}")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)`` for every node that is not its component's smallest.

    A round is one job.  Each task contracts the edges that it has (the first
    round drops repeated ones and so deals them out); then all edges of a node meet, and their task contracts again; where a node still has
    several parents the others hook to the smallest, and each node's parent is
    replaced by that one's.  What leaves a task is at most an edge a node, so
    no node's edges are many, and the join on parents, of which one may be many
    nodes', is one that Spark can split.  Ends with the round in which nothing moves.

    A round's table is removed once the next one has it, the last when nothing
    refers to it any more.  Nodes are of any ordered type that Arrow sorts as
    Spark does; nulls and self-loops link nothing; repeated edges count once.
    """
    spark, folder = edges.sparkSession, None
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        met = _stars(_stars(e if folder else e.distinct()).repartition("u")).groupBy("u").agg(F.array_sort(F.collect_set("v")).alias("vs"))
        # A node is contracted by few tasks, so it has few parents here.
        star = met.select("u", F.col("vs")[0].alias("v"), F.slice("vs", 2, F.size("vs")).alias("more"))
        parent = star.select(F.col("u").alias("k"), F.col("v").alias("p"))
        jumped = star.join(parent, star.v == parent.k, "left").select("u", F.coalesce("p", "v").alias("v"), F.col("v").alias("was"), "more", F.col("p").isNotNull().alias("moved"))
        hooks = F.transform("more", lambda x: F.struct(x.alias("u"), F.col("was").alias("v"), F.lit(True).alias("moved")))
        every = jumped.select(F.explode(F.concat(F.array(F.struct("u", "v", "moved")), hooks)).alias("e")).select("e.*")
        seen = Observation()
        after, other = keep(every.observe(seen, F.count_if("moved").alias("moved")))
        if folder:
            remove(spark, folder)
        e, folder = after, other
        if not seen.get.get("moved"):
            return materialize(e.select(F.col("u").alias("node"), F.col("v").alias("component")), folder)
