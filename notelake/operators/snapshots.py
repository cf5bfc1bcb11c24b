"""Snapshots: what was saved against what is there, retention, restore."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..shared import materialize

TOLERANCE = 0.10
UNREADABLE = "Note not found"
#: Parts that a folder's own files are dealt to, so that one folder of very many isn't compared as a whole.
BUCKETS = 64
#: Partitions that a table of files can be written by, so that only those with differences are read.
SHARDS = 256


def verify_payloads(live: DataFrame, payloads: DataFrame) -> DataFrame:
    """``live(path, size)`` against ``payloads(path, content)``: path, expected, got, status (ok, short, inflated, unreadable)."""
    got = payloads.select(F.col("path").alias("p"), F.col("content"), F.octet_length(T.decode_payload(F.col("path"), F.col("content"))).cast("long").alias("got"))
    both = live.select("path", F.col("size").alias("expected")).join(got, F.col("path") == F.col("p"), "left")
    bad = F.col("content").isNull() | F.col("content").startswith(UNREADABLE) | ((F.col("got") == 0) & (F.col("expected") > 0))
    off = (F.col("got") - F.col("expected")) / F.col("expected")
    status = F.when(bad, "unreadable").when((F.col("expected") > 0) & (off < -TOLERANCE), "short").when((F.col("expected") > 0) & (off > TOLERANCE), "inflated").otherwise("ok")
    return both.select("path", "expected", F.when(~bad, F.col("got")).alias("got"), status.alias("status"))


def snapshot_manifest(verified: DataFrame, snapshot: str) -> DataFrame:
    """One row: counts, bytes and the verdict; ``snapshot_failures`` has the files that failed, and ``verified`` all of them."""
    bad, cut = F.col("status") == "unreadable", F.col("status").isin("short", "inflated")
    m = verified.agg(
        F.count("*").alias("files_in_vault"), F.count_if(~bad).alias("exported"), F.coalesce(F.sum("got"), F.lit(0)).alias("bytes"),
        F.count_if(bad).alias("n_errors"), F.count_if(cut).alias("n_truncated"),
    )
    ok = (F.col("n_errors") == 0) & (F.col("n_truncated") == 0) & (F.col("exported") == F.col("files_in_vault"))
    return m.select(F.lit(snapshot).alias("snapshot"), "*", ok.alias("ok"))


def snapshot_failures(verified: DataFrame, snapshot: str) -> DataFrame:
    """A row a file that wasn't exported whole: snapshot, path, reason, expected, got (null where unreadable)."""
    return verified.where("status <> 'ok'").select(F.lit(snapshot).alias("snapshot"), "path", F.col("status").alias("reason"), "expected", "got")


def verify_snapshot(live: DataFrame, snapshots: DataFrame, now: dt.datetime, max_age_hours: float = 30, least_bytes: float = 0.9) -> DataFrame:
    """The newest of ``snapshots(snapshot yyyyMMdd-HHmmss, path, size)`` against the live files: one row of checks."""
    newest = snapshots.agg(F.max("snapshot").alias("newest"))
    kept = snapshots.join(F.broadcast(newest), F.col("snapshot") == F.col("newest")).groupBy("newest").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    there = live.agg(F.count("*").alias("live_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("live_bytes"))
    age = (F.lit(now.timestamp()) - F.unix_timestamp("newest", "yyyyMMdd-HHmmss")) / 3600
    both = there.crossJoin(kept).withColumn("age_hours", age)  # a row each
    return both.select(
        F.col("newest").alias("snapshot"), "files", "live_files", "bytes", "live_bytes",
        (F.col("files") == F.col("live_files")).alias("count_ok"), (F.col("bytes") >= least_bytes * F.col("live_bytes")).alias("bytes_ok"), (F.col("age_hours") <= max_age_hours).alias("age_ok"),
    )


def missing_files(live: DataFrame, saved: DataFrame) -> DataFrame:
    """``(path, side)``: live files that the snapshot lacks, saved ones that are no longer live."""
    lacks = live.select("path").join(saved.select("path"), "path", "left_anti").withColumn("side", F.lit("not saved"))
    gone = saved.select("path").join(live.select("path"), "path", "left_anti").withColumn("side", F.lit("not live"))
    return lacks.union(gone)


def retention(snapshots: DataFrame, now: dt.datetime, days: int = 7, keep_manifests: int = 30) -> DataFrame:
    """``(snapshot, kind)`` of what goes: copies older than ``days``, and all but the newest manifests."""
    ids = snapshots.select("snapshot").distinct()
    age = F.lit(now.timestamp()) - F.unix_timestamp("snapshot", "yyyyMMdd-HHmmss")
    old = ids.where(age > days * 86400).withColumn("kind", F.lit("notes"))
    rank = F.row_number().over(Window.orderBy(F.desc("snapshot")))  # over ids of snapshots: a few a day
    return old.union(ids.withColumn("r", rank).where(F.col("r") > keep_manifests).select("snapshot", F.lit("manifest")))


def restore(snapshots: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """The newest snapshot, or for each of ``paths(path)`` its newest copy."""
    if paths is None:
        newest = snapshots.agg(F.max("snapshot").alias("newest"))
        return snapshots.join(F.broadcast(newest), F.col("snapshot") == F.col("newest"), "left_semi")
    want = snapshots.join(paths.select("path").distinct(), "path", "left_semi")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("snapshot")))
    return want.withColumn("__r", rank).where("__r = 1").drop("__r")


def restore_check(restored: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(snapshot, restored, exported, complete)``: distinct restored paths of each snapshot of the manifests against the number that was exported.

    A manifest that nothing was restored from has 0; what is restored without
    a manifest has a null number and isn't complete.
    """
    got = restored.groupBy("snapshot").agg(F.countDistinct("path").alias("restored"))
    both = got.join(manifest.select("snapshot", "exported"), "snapshot", "full")
    n = F.coalesce("restored", F.lit(0))
    return both.select("snapshot", n.alias("restored"), "exported", F.coalesce(n == F.col("exported"), F.lit(False)).alias("complete"))


def _folder(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, "(?s)^(.*)/", 1), F.lit(""))


def _placed(saved: DataFrame) -> DataFrame:
    return saved.withColumn("__folder", _folder(F.col("path"))).withColumn("__bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int"))


def _shard() -> Column:
    return F.pmod(F.xxhash64("__folder", "__bucket"), F.lit(SHARDS)).cast("int")


def with_shard(saved: DataFrame) -> DataFrame:
    """``saved`` with ``shard``, to be written by: ``with_shard(saved).write.partitionBy("shard")``."""
    return _placed(saved).withColumn("shard", _shard()).drop("__folder", "__bucket")


def _sums(columns: tuple[str, ...]) -> list[Column]:
    """Four sums of 60 bits each of the rows' hashes: they add up in any order, so no group's rows are gathered."""
    row = F.sha2(F.to_json(F.struct("path", *columns)), 256)
    return [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]


def _digest() -> Column:
    return F.sha2(F.concat_ws("-", *[F.col(f"s{k}").cast("string") for k in range(4)]), 256)


def snapshot_tree(saved: DataFrame, columns: tuple[str, ...] = ("size",)) -> DataFrame:
    """``saved(path, ...)`` -> ``(level, parent, folder, bucket, files, digest)``: digests of ``path`` and ``columns`` by folder.

    The root is level 0 with a null parent.  A folder's children, a level below it, are
    its folders (null bucket) and BUCKETS parts of its own files; its sums are theirs
    added up, and the digest is the sums' hash.  Write it ``partitionBy("level")``.
    Repeated rows count as often as they stand; a null path is a file of the root.
    """
    own = _placed(saved).groupBy("__folder", "__bucket").agg(F.count("*").alias("files"), *_sums(columns))
    parts = F.filter(F.split("__folder", "/"), lambda x: F.col("__folder") != "")
    above = F.transform(F.sequence(F.lit(0), F.size("parts")), lambda k: F.struct(
        k.alias("level"), F.when(k > 0, F.array_join(F.slice("parts", 1, k - 1), "/")).alias("parent"),
        F.array_join(F.slice("parts", 1, k), "/").alias("folder"), F.lit(None).cast("int").alias("bucket"),
    ))
    self_ = F.struct((F.size("parts") + 1).alias("level"), F.col("__folder").alias("parent"), F.col("__folder").alias("folder"), F.col("__bucket").alias("bucket"))
    nodes = own.withColumn("parts", parts).select(F.explode(F.concat(above, F.array(self_))).alias("n"), "files", "s0", "s1", "s2", "s3")
    added = nodes.groupBy("n").agg(F.sum("files").alias("files"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(4)])
    return added.select("n.*", "files", _digest().alias("digest"))


def _differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(folder, bucket)`` of the nodes that only one tree has or whose digests differ."""
    key = lambda d, t: d.select("folder", F.coalesce("bucket", F.lit(-1)).alias("b"), F.col("digest").alias(t))
    both = key(before, "was").join(key(after, "now"), ["folder", "b"], "full").where("not was <=> now")
    return both.select("folder", F.when(F.col("b") >= 0, F.col("b")).alias("bucket"))


def tree_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Trees of two snapshots -> ``(folder, bucket)`` of the parts that differ, found from the root down.

    A level is read only if a folder above it differs, and of it only the
    children of such folders are compared; equal trees cost one row each.  As
    many small jobs as the differences are deep.
    """
    found = materialize(_differing(before.where("level = 0"), after.where("level = 0")))
    parts, level = found.where("bucket is not null"), 0
    while not (above := found.where("bucket is null")).isEmpty():
        level += 1
        wanted = above.select(F.col("folder").alias("parent"))
        below = [tree.where(F.col("level") == level).join(wanted, "parent", "left_semi") for tree in (before, after)]
        found = materialize(_differing(*below))
        parts = parts.union(found.where("bucket is not null"))
    return parts


def changed_files(before: DataFrame, after: DataFrame, before_tree: DataFrame, after_tree: DataFrame, columns: tuple[str, ...] = ("size",)) -> DataFrame:
    """``(path, change)`` between two snapshots, change being added, removed or changed, by their trees.

    Only files of parts that differ are joined.  Tables written by
    ``with_shard``'s ``shard`` are read only where such parts lie (the at most
    SHARDS numbers are collected).  A path with repeated rows is changed if
    they differ, in whatever order; a null path is one like any other.
    """
    parts = tree_differences(before_tree, after_tree).select(F.col("folder").alias("__folder"), F.col("bucket").alias("__bucket"))
    shards = [r[0] for r in parts.select(_shard()).distinct().collect()]

    def of(files: DataFrame, name: str) -> DataFrame:
        near = files.where(F.col("shard").isin(shards)) if "shard" in files.columns else files
        rows = _placed(near).join(parts, ["__folder", "__bucket"], "left_semi")
        return rows.groupBy("path").agg(*_sums(columns)).select(F.col("path").alias(f"path_{name}"), _digest().alias(name))

    both = of(before, "was").join(of(after, "now"), F.col("path_was").eqNullSafe(F.col("path_now")), "full").where("not was <=> now")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.select(F.coalesce("path_was", "path_now").alias("path"), change.alias("change"))
