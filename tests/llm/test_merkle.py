import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from notelake.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))


def tree(nodes):
    """The root, and for each node the (place, siblings) of all levels, by plain lists."""
    under, paths = [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(nodes) > 1:
        more, over = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k in range(len(run)):
                for i in under[at + k]:
                    paths[i].append((k, run[:k] + run[k + 1 :]))
            more.append(sha(*run))
            over.append([i for u in under[at : at + 16] for i in u])
        nodes, under = more, over
    return nodes[0], paths


def slow(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    keys = sorted(by, key=lambda k: (k is not None, (k or "").encode()))
    subs, own = [], {}
    for k in keys:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, own[k] = tree([leaf(r) for r in by[k]])
        subs.append(sub)
    root, tops = tree(subs)
    out = []
    for k, sub, top in zip(keys, subs, tops):
        for r, path in zip(by[k], own[k]):
            node = leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                node = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for at, sibs in path + top:
                node = sha(*sibs[:at], node, *sibs[at:])
            out.append((r[0], leaf(r), sub, root, sha(*(s for _, sibs in path + top for s in sibs)), node, node == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in merkle.manifest(df, merkle.with_changed_case(df)).collect()), key=repr)


def rows_of(sizes):
    out = []
    for source, n in sizes:
        out += [((i * 7919) % 100003, source, "en" if i % 3 else None, i if i % 5 else None, f"Text {i} of Ü {source}") for i in range(n)]
    return out


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_against_plain_tree(spark, monkeypatch, levels):
    """Sizes on both sides of a run's and a block's, groups of one, the null group, more groups than a run."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**levels)
    rows = rows_of([("a", 1), ("b", 16), ("é", 17), (None, 33), ("c", 256), ("d", 257), ("", 3), ("hot", 1100), *((f"s{i}", 1 + i % 2) for i in range(19))])
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == slow(rows)


def test_awkward_rows(spark):
    rows = [(None, "a", None, None, None), (None, "a", None, None, ""), (1, None, "en", 3, "ABC"), (1, None, "en", 3, "ABC"), (1, None, "en", 3, "abc"), (2, "a", "en", 0, ""), (5, "a", "en", 1, None), (7, "b", "x", 9, "Z" * 100_000)]
    rows += [(9, "b", "en", 1, "Same")] * 40
    df = spark.createDataFrame([(*r, "k", 0) for r in rows], SCHEMA + ", key string, pos int")
    assert got(df) == slow(rows)
    assert got(df.limit(0)) == []
    assert got(spark.createDataFrame(rows[:1], SCHEMA)) == slow(rows[:1])


def test_tampering_is_seen_and_nothing_else(spark):
    rows = rows_of([("a", 500), ("b", 40)])
    bad = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert {r[0] for r in got(spark.createDataFrame(rows, SCHEMA)) if not r[-1]} == bad


def test_paths_fold_to_the_root(spark):
    """The paths themselves: by built-in functions, by `fold`, and after packing."""
    df = spark.createDataFrame(rows_of([("a", 300), ("b", 1), ("c", 20)]), SCHEMA)
    out = merkle.manifest(df, paths=True)
    assert out.where(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    for r in out.limit(20).collect():
        path = [(p["at"], p["siblings"]) for p in r["path"]]
        assert merkle.fold(r["leaf"], merkle.unpack(merkle.pack(path))) == r["root"]
    assert out.where("not verified").count() == 0


def test_traversal_holds_runs_only():
    """Existing and desired runs: never more than FANOUT digests a level, whatever the block's size."""
    grown = merkle.Growing(3)
    for k in range(4096):
        grown.add(sha(str(k)), k == 4095)
        assert all(len(level) <= 16 for level in grown.open)
    leaves = [sha(str(k)) for k in range(4096)]
    root, paths = tree(leaves)
    assert grown.run() == [root]
    for want, path in zip(paths, merkle.traverse(leaves, 3), strict=True):
        assert [(at, run[:at] + run[at + 1 :]) for at, run, _ in path] == want
