"""Centroid clustering by kd-tree filtering, in exact integers.

Vectors become integers, and a task makes a kd-tree of each BLOCK of those it
reads, once: a node has the number of its vectors, their sum and their box.
In a round a node is passed with the centroids that may be nearest to one of its
vectors.  With ``z`` the one nearest to the middle of the box, another is
dominated if it is farther than ``z`` even at the corner that favours it most;
only strictly dominated ones go, so ties are left to the leaves.  If one is left, the
whole node is its own; a leaf is resolved vector by vector.  A task returns a
number and a sum for each centroid, which Spark adds up.

Integers below SMALL in size are int64, in which no square or sum overflows;
a block with larger ones is computed in Python's integers, by the same code.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize

#: Vectors of a tree, and of a leaf, at most.
BLOCK, LEAF = 4096, 32
#: Size below which a component is computed in int64.
SMALL = 1 << 26
#: Sums are sent as multiples of this and a rest.
LIMB = 1 << 40
LARGEST = (1 << 63) - 1
#: Largest size of a 32-bit float; beyond it a component counts as infinite.
FLOAT_MAX = float(np.finfo(np.float32).max)


class Tree:
    """A kd-tree over the rows of an integer array.  Nodes are in preorder; a node's rows are ``start`` to ``end``, ``right`` is its second child or 0."""

    def __init__(self, points: np.ndarray) -> None:
        self.order = np.arange(len(points))
        self.start: list[int] = []
        self.end: list[int] = []
        self.right: list[int] = []
        low, high, total = [], [], []

        def grow(a: int, b: int) -> None:
            own, at = points[self.order[a:b]], len(self.start)
            box = own.min(0), own.max(0)
            self.start.append(a)
            self.end.append(b)
            self.right.append(0)
            low.append(box[0])
            high.append(box[1])
            total.append(own.sum(0))
            wide = box[1] - box[0]
            if b - a > LEAF and wide.any():  # equal vectors are one leaf, however many
                d, mid = int(np.argmax(wide)), (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argsort(own[:, d], kind="stable")]
                grow(a, a + mid)
                self.right[at] = len(self.start)
                grow(a + mid, b)

        grow(0, len(points))
        self.low, self.high, self.total = np.stack(low), np.stack(high), np.stack(total)
        self.points = points[self.order]

    def dump(self) -> dict:
        kind = "<i8" if self.points.dtype != object else None
        store = (lambda a: a.astype(kind).tobytes()) if kind else (lambda a: " ".join(map(str, a.ravel())).encode())
        return {"small": bool(kind), "shape": [self.start, self.end, self.right], **{n: store(getattr(self, n)) for n in ("points", "low", "high", "total")}}

    @classmethod
    def load(cls, row: dict, dims: int) -> Tree:
        self = cls.__new__(cls)
        self.start, self.end, self.right = row["shape"]
        read = (lambda b: np.frombuffer(b, "<i8")) if row["small"] else (lambda b: np.array([int(x) for x in b.split()], object))
        for n in ("points", "low", "high", "total"):
            setattr(self, n, read(row[n]).reshape(-1, dims))
        return self

    def filtered(self, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(node, candidates)``: nodes that end the search, and the centroids left there, ascending."""

        def walk(at: int, left: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            if len(left) > 1:
                own, low, high = centroids[left], self.low[at], self.high[at]
                best = int(np.argmin(((2 * own - (low + high)) ** 2).sum(1)))
                corner = np.where(own > own[best], high, low)
                left = left[((own - corner) ** 2).sum(1) <= ((own[best] - corner) ** 2).sum(1)]  # its own corner is no nearer to itself
            if len(left) == 1 or not self.right[at]:
                yield at, left
            else:
                yield from walk(at + 1, left)
                yield from walk(self.right[at], left)

        yield from walk(0, np.arange(len(centroids)))

    def nearest(self, at: int, left: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """The number of the nearest centroid of each vector of a node; of the smallest of those that tie."""
        own = self.points[self.start[at] : self.end[at]]
        far = np.stack([((own - centroids[z]) ** 2).sum(1) for z in left], 1)
        return left[np.argmin(far, 1)]

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and sum of the vectors of each centroid."""
        n, total = np.zeros(len(centroids), np.int64), np.zeros_like(centroids)
        for at, left in self.filtered(centroids):
            if len(left) == 1:
                n[left[0]] += self.end[at] - self.start[at]
                total[left[0]] += self.total[at]
            else:
                label = self.nearest(at, left, centroids)
                np.add.at(total, label, self.points[self.start[at] : self.end[at]])
                n += np.bincount(label, minlength=len(n))
        return n, total

    def labels(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each vector, in the tree's order."""
        label = np.zeros(len(self.points), np.int64)
        for at, left in self.filtered(centroids):
            label[self.start[at] : self.end[at]] = left[0] if len(left) == 1 else self.nearest(at, left, centroids)
        return label, ((self.points - centroids[label]) ** 2).sum(1)


def whole(values: np.ndarray) -> np.ndarray:
    """Integers of doubles that are whole: int64 where all are small, else Python's."""
    if not values.size or np.abs(values).max() < SMALL:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def fitting(points: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """The centroids as integers of the kind that no product with these points overflows."""
    small = points.dtype != object and max((abs(x) for c in centroids for x in c), default=0) < SMALL
    return np.array(centroids, np.int64 if small else object)


def kept_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, e)`` of the vectors with ``dims`` components, none null or non-finite; ``e``: floor(scale * x), as doubles."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > FLOAT_MAX))
    # Beyond a long doubles are whole already.
    whole_of = F.transform(v, lambda x: F.when(F.abs(x) < 2.0**50, F.floor(F.lit(float(scale)) * x).cast("double")).otherwise(F.lit(float(scale)) * x))
    usable = F.coalesce((F.size(v) == dims) & ~bad, F.lit(False))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("vec_id"), whole_of.alias("e"))


def grown_trees(kept: DataFrame, dims: int) -> DataFrame:
    """A row a tree, of up to BLOCK vectors as a task reads them; nothing is shuffled."""
    columns = [("ids", pa.list_(pa.int64())), ("small", pa.bool_()), ("shape", pa.list_(pa.list_(pa.int32()))), *((n, pa.binary()) for n in ("points", "low", "high", "total"))]
    schema = pa.schema(columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def tree() -> pa.RecordBatch:
            ids = np.concatenate([np.array(b.column(0).to_pylist(), object) for b in held])
            tree = Tree(whole(np.concatenate([np.asarray(b.column(1).flatten()).reshape(-1, dims) for b in held])))
            return pa.RecordBatch.from_pylist([{"ids": ids[tree.order].tolist(), **tree.dump()}], schema)

        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                if n + part.num_rows > BLOCK:
                    yield tree()
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield tree()

    return kept.mapInArrow(each, "ids array<long>, small boolean, shape array<array<int>>, points binary, low binary, high binary, total binary")


def _limbs(value: int) -> tuple[Decimal, Decimal]:
    high, low = divmod(int(value), LIMB)
    return Decimal(high), Decimal(low)


def moved(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: of each that is nearest to some vector the floor of their mean, the others as they were."""
    dims = len(centroids[0])
    schema = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("high", pa.decimal128(38)), ("low", pa.decimal128(38))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centroids), object), np.zeros((len(centroids), dims), object)
        for b in batches:
            for row in b.to_pylist():
                tree = Tree.load(row, dims)
                more, sums = tree.sums(fitting(tree.points, centroids))
                n, total = n + more.astype(object), total + sums.astype(object)
        out = [(c, d, *_limbs(x)) for c in range(len(centroids)) if n[c] for d, x in enumerate([n[c], *total[c]])]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    added = trees.mapInArrow(each, "cluster int, dim int, high decimal(38,0), low decimal(38,0)").groupBy("cluster", "dim").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    value = {(r["cluster"], r["dim"]): int(r["high"]) * LIMB + int(r["low"]) for r in added.collect()}  # a row a centroid and component
    return [[value[c, d + 1] // value[c, 0] for d in range(dims)] if (c, 0) in value else own for c, own in enumerate(centroids)]


def assigned(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``(vec_id, cluster, distance)`` of every vector; a squared distance beyond a long is the largest long."""
    dims = len(centroids[0])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tree = Tree.load(row, dims)
                label, far = tree.labels(fitting(tree.points, centroids))
                far = [min(int(x), LARGEST) for x in far]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(label.astype(np.int32)), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(each, "vec_id long, cluster int, distance long")


def kmeans(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every vector kept, and the centroids.

    Kept are vectors of exactly ``dims`` components, none null, non-finite or
    beyond a 32-bit float.  A component is ``floor(scale * x)``.  Centroids start
    as the ``k`` vectors with the smallest SHA-256 of ``<seed>:<vec_id>``; equal
    ids by their components, a vector without an id after all others.
    With fewer vectors there are fewer centroids; with none no rows.  Rows that
    repeat an id, and equal rows, are vectors of their own.  Ties go to the
    smaller number; an empty centroid stays.  Distances are squared; one, or a
    sum, beyond a long is the largest long.  Other columns are left out.
    """
    kept = kept_vectors(vectors, dims, scale, id_col, vector_col)
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "e")
    centroids = [[int(x) for x in r["e"]] for r in first.orderBy(F.asc_nulls_last("h"), "e").limit(k).collect()]
    trees = materialize(grown_trees(kept, dims))
    if not centroids:
        kind = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], kind), []
    for _ in range(rounds):
        centroids = moved(trees, centroids)
    out = materialize(assigned(trees, centroids))
    sums = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    of = lambda values: F.element_at(F.create_map(*[x for c, v in values.items() for x in (F.lit(c), F.lit(v))]), F.col("cluster"))
    long_of = lambda n: F.lit(min(n, LARGEST)).cast("long")
    inertia = of({c: long_of(n) for c, n in sums.items()})
    sha = of({c: sha256(",".join(map(str, own)).encode()).hexdigest() for c, own in enumerate(centroids)})
    return out.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), long_of(sum(sums.values())).alias("inertia"), sha.alias("centroid_sha256")), centroids
