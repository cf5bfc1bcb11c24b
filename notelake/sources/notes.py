"""Reading and writing notes, indexes and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..shared import exists


def read_notes_dir(spark: SparkSession, folder: str) -> DataFrame:
    """Every file below ``folder``, whole: path relative to it, text, mtime, size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.split("://")[-1].rstrip("/").removeprefix("file:")
    return files.select(
        F.regexp_replace(F.url_decode(F.regexp_replace(F.col("path"), r"\+", "%2B")), f"^.*?{root}/", "").alias("path"),
        F.decode("content", "UTF-8").alias("text"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
    )


def read_raw_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema.RAW_DOCS).json(path)


def live_docs(raw: DataFrame) -> DataFrame:
    """Files that exist: no content blocks, no system documents, not deleted, with a path."""
    mine = ~F.col("_id").startswith("h:") & ~F.col("_id").startswith("_")
    alive = (F.coalesce("path", F.lit("")) != "") & ~F.coalesce("deleted", F.lit(False))
    return raw.where(mine & alive).select("path", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("mtime", F.lit(0)).cast("long").alias("mtime"))


def write_index(index: dict[str, DataFrame], folder: str) -> None:
    """Tables of an index as Parquet; chunks lie together by path, postings by term."""
    for name, df in index.items():
        if name == "postings":
            df = df.repartitionByRange("term", "cls", F.xxhash64("path")).sortWithinPartitions("term", "cls")
        (df.repartition("path") if name == "chunks" else df).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables that an index has; one that was written without some (by an older build) lacks them here too."""
    there = lambda name: exists(spark, f"{folder}/{name}")
    return {name: spark.read.schema(kind).parquet(f"{folder}/{name}") for name, kind in schema.INDEX.items() if there(name)}


def write_snapshot(notes: DataFrame, folder: str, snapshot: str) -> None:
    """All files under the snapshot's partition; other snapshots stay."""
    notes.withColumn("snapshot", F.lit(snapshot)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(f"{folder}/notes")


def write_manifest(manifest: DataFrame, folder: str, snapshot: str) -> None:
    """The manifest under its own name and as the latest."""
    for name in (snapshot, "latest"):
        manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifests/{name}")
