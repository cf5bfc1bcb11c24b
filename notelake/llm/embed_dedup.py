"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Equal vectors are one node with a multiplicity.  Nodes are dealt to blocks of a
bounded number, every pair of blocks is a cell, and a cell's task multiplies
tiles of unit vectors quantised to int8 (one scale a vector).  With ``e`` the
norm of a vector's quantisation error and ``q`` its quantised form,
``|a.b - qa.qb| <= |ea| + |qa| |eb|`` for unit vectors, so a pair below
``threshold`` by more than that bound can't be one; every other pair is computed
again in double precision.  Products of int8 values are summed exactly: for up
to 1,040 components the sums stay below 2^24, where float32 holds all integers
(longer vectors are summed in double).

A cell returns, for each of its nodes, the rows it is linked to there and one
edge of a spanning star; it never returns pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import connected_components, materialize
from .simhash import spanning

#: Vectors of a block, at most and at least, about; and of a tile.
BLOCK, SMALL_BLOCK, TILE = 8192, 256, 1024
#: Tasks that cells are dealt to, at most; a task takes its cells one by one.
MAX_TASKS = 1 << 14
#: Pairs computed again at once.
EXACT = 1 << 16


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Int8 values, scale, norm of the error and norm of the quantised vector, for unit rows; the norms are rounded up."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    up = 1e-12
    return q, scale, np.linalg.norm(unit - back, axis=1) + up, np.linalg.norm(back, axis=1) + up


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows with a cosine of at least ``threshold``; with ``same``, i < j only."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    qa, sa, ea, ma = quantise(a / na[:, None])
    qb, sb, eb, _ = quantise(b / nb[:, None])
    exact_in = np.float32 if a.shape[1] <= 1040 else np.float64
    qa, qb = qa.astype(exact_in), qb.astype(exact_in)
    for i in range(0, len(a), TILE):
        rows = slice(i, i + TILE)
        for j in range(i if same else 0, len(b), TILE):
            cols = slice(j, j + TILE)
            product = qa[rows] @ qb[cols].T
            # First by row with the tile's largest bound, then the few that are left by their own.
            low = threshold - ea[rows] - ma[rows] * eb[cols].max() - 1e-9
            limit = np.where(low > 0, low / (sa[rows] * sb[cols].max()), low / (sa[rows] * sb[cols].min()))
            x, y = np.nonzero(product >= (limit - np.abs(limit) * 1e-6)[:, None])
            near = product[x, y].astype(float) * sa[rows][x] * sb[cols][y]
            keep = near >= threshold - ea[rows][x] - ma[rows][x] * eb[cols][y] - 1e-9
            x, y = x[keep] + i, y[keep] + j
            if same:
                keep = x < y
                x, y = x[keep], y[keep]
            for at in range(0, len(x), EXACT):
                u, v = x[at : at + EXACT], y[at : at + EXACT]
                keep = np.einsum("ij,ij->i", a[u], b[v]) / (na[u] * nb[v]) >= threshold
                left.append(u[keep])
                right.append(v[keep])
    return np.concatenate(left), np.concatenate(right)


def _cell(table: pa.Table, threshold: float) -> pa.Table:
    table = table.combine_chunks()
    own, rep, rows, dims = (table.column(c).to_numpy() for c in ("own", "rep", "n", "d"))
    vectors, home = table.column("v"), table.column("home").to_numpy()
    diagonal = table.column("x")[0] == table.column("y")[0]
    first = table.column("x")[0].as_py()
    links, a, b = np.zeros(len(own), np.int64), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        m = np.asarray(vectors.take(pa.array(at)).combine_chunks().flatten(), np.float64).reshape(len(at), d)
        m = m / np.abs(m).max(1, keepdims=True)  # no overflow in squares; the cosine stays
        if diagonal:
            x, y = tile_links(m, m, threshold, True)
            x, y = at[x], at[y]
        else:
            here = home[at] == first
            x, y = tile_links(m[here], m[~here], threshold, False)
            x, y = at[here][x], at[~here][y]
        np.add.at(links, x, rows[y])
        np.add.at(links, y, rows[x])
        a.append(x)
        b.append(y)
    a, b = np.concatenate(a), np.concatenate(b)
    pair = np.arange(len(a))
    root = spanning(np.r_[pair, pair], np.r_[a, b], rep) if len(a) else rep
    has = np.flatnonzero(links)
    return pa.table({"rep": rep[has], "links": links[has], "root": root[has]})


def embedding_components(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` of every row; links are cosines of at least ``threshold``, in double precision.

    ``n_links``: other rows linked directly; ``component_id``: the smallest
    vec_id reachable, itself included; ``kept``: whether it is that.  Vectors
    that are null, empty or zero, or hold a null or non-finite component, link
    with nothing, nor do vectors of different length.  A row without an id links
    with nothing and has a null component; rows that repeat an id are rows of
    their own, which their id doesn't link.  Other columns are left out.
    """
    # Single floats are sent as they are and widened in the task.
    v = F.col(vector_col)
    v = v if dict(vectors.dtypes)[vector_col] == "array<float>" else v.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0) & F.col(id_col).isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, v).alias("v"))
    distinct = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # Numbers are fixed by being written.
    nodes = materialize(distinct.withColumn("rep", F.monotonically_increasing_id()))
    n, cores = nodes.count(), vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / BLOCK), min(math.ceil(n / SMALL_BLOCK), math.ceil(math.sqrt(8 * cores))))  # a few cells a core where there are that many vectors
    dealt = nodes.select("rep", "n", F.size("v").alias("d"), "v", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("home"))
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    cells = cells.select(F.least("home", "other").alias("x"), F.greatest("home", "other").alias("y"), F.col("rep").alias("own"), "rep", "n", "d", "v", "home")
    found = cells.repartition(min(MAX_TASKS, blocks * (blocks + 1) // 2), "x", "y").groupBy("x", "y").applyInArrow(lambda t: _cell(t, threshold), "rep long, links long, root long")
    found = materialize(found)
    roots = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    sums = found.groupBy("rep").agg(F.sum("links").alias("links")).withColumnRenamed("rep", "r")
    named = nodes.join(sums, nodes.rep == sums.r, "left").join(roots, nodes.rep == roots.node, "left").select(
        F.col("v").alias("w"), "least", F.coalesce("component", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")
    )
    ids = named.groupBy(F.col("root").alias("id_root")).agg(F.min("least").alias("component"))
    named = named.join(ids, named.root == ids.id_root).select("w", "links", "component")
    out = rows.join(named, rows.v == named.w, "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
