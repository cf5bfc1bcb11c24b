from hashlib import sha256

import numpy as np
import pytest

from notelake.llm import kdmeans

SCHEMA = "vec_id long, embedding array<float>"
TOP = (1 << 63) - 1


def slow(rows, k, rounds, dims):
    """Lloyd's rounds over Python's integers, every vector against every centroid."""
    own = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(own, key=lambda r: (r[0] is None, sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    for step in range(rounds + 1):
        label = [min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c)) for _, v in own]
        if step < rounds:
            for c in range(len(centroids)):
                mine = [v for (_, v), at in zip(own, label) if at == c]
                if mine:
                    centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    dist = [far(v, centroids[c]) for (_, v), c in zip(own, label)]
    clipped = [min(d, TOP) for d in dist]
    sums = {c: sum(d for d, at in zip(clipped, label) if at == c) for c in label}
    sha = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, min(sums[c], TOP), min(sum(clipped), TOP), sha[c]) for (i, _), c, d in zip(own, label, clipped)), key=repr)


def got(df, **more):
    return sorted((tuple(r) for r in kdmeans.kmeans(df, **more)[0].collect()), key=repr)


def clustered(n, dims, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dims)) * 3
    return [(int(i), (centres[i % 9] + rng.normal(size=dims) * spread).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize(("dims", "spread", "block"), [(2, 0.2, 4096), (3, 2.0, 100), (64, 0.3, 200), (64, 3.0, 4096)])
def test_against_all_distances(spark, monkeypatch, dims, spread, block):
    monkeypatch.setattr(kdmeans, "BLOCK", block)
    rows = clustered(600, dims, spread, dims)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3), dims=dims) == slow(rows, 16, 3, dims)


def test_ties_go_to_the_smaller_number(spark):
    """A grid of few values: many vectors are as near to one centroid as to another."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-2, 3, 2) / 64).tolist()) for i in range(400)]
    assert got(spark.createDataFrame(rows, SCHEMA), dims=2, k=7) == slow(rows, 7, 3, 2)


def test_awkward_rows(spark):
    v = [0.5, -0.25, 3.0]
    rows = [(1, v), (1, v), (1, [1.0, 2.0, 3.0]), (None, [9.0, 9.0, 9.0]), (None, v), (2, None), (3, []), (4, v[:2]), (5, [1.0, None, 2.0]), (6, [float("nan")] * 3), (7, [float("inf"), 0.0, 0.0]), (8, [0.0] * 3)]
    rows += [(20 + i % 3, [-1.0, -1.01, 2.0]) for i in range(90)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", cluster int, e string")
    assert got(df, dims=3, k=4) == slow(rows, 4, 3, 3)
    assert got(df, dims=3) == slow(rows, 16, 3, 3)
    assert got(df.limit(0), dims=3) == [] and kdmeans.kmeans(df.limit(0), dims=3)[1] == []


def test_large_components(spark):
    """Beyond int64: exact all the same, and longs stop at the largest."""
    rows = [(i, [3e38 * (-1) ** i, float(i), 1e12 * i]) for i in range(40)] + [(100 + i, [float(i), 0.0, 1.0]) for i in range(40)]
    assert got(spark.createDataFrame(rows, SCHEMA), dims=3, k=5) == slow(rows, 5, 3, 3)


def test_nodes_are_taken_whole():
    """The filter does its work: on clustered vectors most nodes end with one centroid, far above the leaves."""
    rows = clustered(4000, 2, 0.05, 1)
    tree = kdmeans.Tree(kdmeans.whole(np.floor(64 * np.array([v for _, v in rows]))))
    centroids = np.array([tree.points[tree.order.tolist().index(i)] for i in range(9)])
    ends = list(tree.filtered(centroids))
    alone = sum(tree.end[at] - tree.start[at] for at, left in ends if len(left) == 1)
    assert alone > 0.85 * len(rows) and len(ends) < len(rows) / kdmeans.LEAF
    back = kdmeans.Tree.load(tree.dump(), 2)
    assert (back.points == tree.points).all() and back.right == tree.right
