"""Digest trees of snapshots against comparing all files."""

import random
from collections import Counter, defaultdict

import pytest

from notelake.operators.snapshots import changed_files, snapshot_tree, tree_differences, with_shard

SCHEMA = "path string, size long"
PATHS = ["a.md", "/a.md", "x/a.md", "x/b.md", "x/y/a.md", "x/y/z/c.md", "//d.md", "x//d.md", "x/y", "é/ñ.md", "x\ny/e.md", "", None] + [f"big/n{i}.md" for i in range(300)] + [f"f{i}/g/h.md" for i in range(30)]


def plain(before, after):
    was, now = defaultdict(Counter), defaultdict(Counter)
    for rows, into in ((before, was), (after, now)):
        for p, s in rows:
            into[p][s] += 1
    return {(p, "added" if p not in was else "removed" if p not in now else "changed") for p in was.keys() | now.keys() if was.get(p) != now.get(p)}


@pytest.mark.parametrize("seed", range(4))
def test_changes(spark, seed):
    r = random.Random(seed)
    before = [(p, r.choice([1, 2, None])) for p in PATHS for _ in range(r.choice([1, 1, 1, 2]))]
    # Few changes, many, rows in another order, and a snapshot without any file.
    rate = [0.01, 0.5, 0, 1][seed]
    after = [(p, s if r.random() > rate else 7) for p, s in before if r.random() >= rate / 2] + [("new/one.md", 1)] * (seed < 2)
    r.shuffle(after)
    after = [] if seed == 3 else after
    a, b = (spark.createDataFrame(rows, SCHEMA) for rows in (before, after))
    got = changed_files(a, b, snapshot_tree(a), snapshot_tree(b)).collect()
    assert len(got) == len({x.path for x in got})
    assert {tuple(x) for x in got} == plain(before, after)


def test_tree(spark):
    rows = [(p, 1) for p in PATHS]
    t = snapshot_tree(spark.createDataFrame(rows, SCHEMA))
    root = t.where("level = 0").collect()
    assert len(root) == 1 and root[0].files == len(PATHS) and root[0].parent is None and root[0].folder == ""
    assert {x.files for x in t.where("folder = 'big' and bucket is null").collect()} == {300}
    # A folder has as many files as its children have.
    below = {(x.parent, x.level - 1): x.n for x in t.where("level > 0").groupBy("parent", "level").sum("files").withColumnRenamed("sum(files)", "n").collect()}
    assert all(below[x.folder, x.level] == x.files for x in t.where("bucket is null").collect())


def test_only_what_differs_is_compared(spark, tmp_path):
    rows = [(p, 1) for p in PATHS if p]
    after = [(p, 2 if p == "x/y/z/c.md" else s) for p, s in rows]
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(after, SCHEMA)
    ta, tb = snapshot_tree(a), snapshot_tree(b)
    assert tree_differences(ta, ta).count() == 0
    assert [x.folder for x in tree_differences(ta, tb).collect()] == ["x/y/z"]
    for name, d in (("a", a), ("b", b)):
        with_shard(d).write.partitionBy("shard").parquet(f"{tmp_path}/{name}")
    hit = with_shard(a).where("path = 'x/y/z/c.md'").first().shard
    # Whatever lies in other shards can't even be read.
    for f in tmp_path.glob("*/shard=*/*.parquet"):
        if f.parent.name != f"shard={hit}":
            f.write_bytes(b"")
            (f.parent / f".{f.name}.crc").unlink()
    fa, fb = (spark.read.schema(SCHEMA + ", shard int").parquet(f"{tmp_path}/{n}") for n in "ab")
    assert [tuple(x) for x in changed_files(fa, fb, ta, tb).collect()] == [("x/y/z/c.md", "changed")]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert changed_files(none, none, snapshot_tree(none), snapshot_tree(none)).count() == 0


def test_clashing_columns(spark):
    rows = spark.createDataFrame([("a/b.md", 1, "f", 3)], SCHEMA + ", folder string, bucket int")
    more = spark.createDataFrame([("a/b.md", 2, "f", 3)], SCHEMA + ", folder string, bucket int")
    assert [tuple(x) for x in changed_files(rows, more, snapshot_tree(rows), snapshot_tree(more)).collect()] == [("a/b.md", "changed")]
