"""Similar notes: pairs over a threshold, proposed links, near-duplicates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..shared import materialize
from .graph import raw_links

# Fixed values.
EXCLUDED_FOLDERS = ("03-Personal/Secrets", "06-Todo", "05-Archive", ".obsidian")
INDEX_NOTE = "00-INDEX.md"
DERIVED = ("investigacion", "setup", "informe", "research", "test", "notas", "draft", "wip", "deep-dive")
SECTION = "Notas relacionadas"
#: Vectors of a block, at most; blocks, if there are vectors for so many of SMALL; tasks that pairs of blocks are dealt to, at most.
BLOCK, SMALL, LEAST_BLOCKS, MAX_TASKS = 1 << 16, 4096, 12, 1 << 14
#: Decimals of a score, so that copies tie whatever the order in which a product is summed.
DECIMALS = 9
#: Vectors of the sample for each pivot: which are pivots decides how much is saved, not what is found.
PIVOT_SAMPLE = 4
#: Pivots, at most; rows and columns of a product; what an angle may be off; what a product in single floats may be off.
MAX_PIVOTS, STRIPE, COLUMNS, ANGLE_ERROR, SLACK = 1024, 256, 8192, 1e-6, 2e-5
#: Links and notes of a name that a task holds against each other.
SQUARE = 2048
#: Pairs of a product that are computed one by one, at most; pairs that leave a task at once.
FEW, BATCH = 1 << 13, 1 << 16


def note_vectors(chunks: DataFrame) -> DataFrame:
    """``(path, vec)``: the mean of a note's chunk vectors, at unit length; zero ones are left out."""
    mean = chunks.where("vec is not null").groupBy("path").agg(Summarizer.mean(array_to_vector(F.col("vec").cast("array<double>"))).alias("m"))
    return mean.select("path", V.unit(vector_to_array("m")).alias("vec")).where("vec is not null")


def eligible_notes(notes: DataFrame) -> DataFrame:
    out = F.col("path") != INDEX_NOTE
    for f in EXCLUDED_FOLDERS:
        out = out & ~F.col("path").startswith(f)
    return notes.where(out)


def link_names(notes: DataFrame, compat: bool = False) -> DataFrame:
    """Distinct ``(src, key)``: the names that a note links to, in lower case."""
    key = F.regexp_replace(F.lower("target"), r"[.md]+$" if compat else r"\.md$", "")
    return raw_links(notes).select(F.col("path").alias("src"), key.alias("key")).distinct()


def current_links(notes: DataFrame, compat: bool = False) -> DataFrame:
    """Distinct ``(src, dst)`` by name alone, to every note of that name but the note itself.

    Its size is that of links times notes of a name; to hold pairs against what
    is linked, ``unlinked`` needs the names only, and ``link_degrees`` counts links without making them.  A
    name with many links and notes is dealt in squares, each side copied as often as the other has stretches.
    """
    own = materialize(link_names(notes, compat))
    # A note has one name and links to a name once, so no pair comes twice.
    names = _named(notes)
    sizes = own.groupBy("key").agg(F.count("*").alias("n")).join(names.groupBy("key").agg(F.count("*").alias("m")), "key")
    parts = lambda n: F.ceil(F.col(n) / SQUARE).cast("int")
    big = materialize(sizes.where(f"n > {SQUARE} or m > {SQUARE}").select("key", parts("n").alias("n"), parts("m").alias("m")))
    squares = big.agg(F.coalesce(F.sum(F.col("n").cast("long") * F.col("m")), F.lit(0))).first()[0]
    tasks = min(MAX_TASKS, 4 * squares) if squares else 0

    def dealt(df: DataFrame, path: str, mine: str, others: str) -> DataFrame:
        out = df.join(F.broadcast(big), "key", "left").withColumns({mine: F.coalesce(mine, F.lit(1)), others: F.coalesce(others, F.lit(1))})
        out = out.select("key", path, F.pmod(F.xxhash64(path), mine).cast("int").alias(f"{mine}_at"), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(f"{others}_at"))
        return out.repartition(tasks, "key", "n_at", "m_at") if tasks else out

    both = dealt(own, "src", "n", "m").join(dealt(names, "dst", "m", "n"), ["key", "n_at", "m_at"])
    return both.where("src <> dst").select("src", "dst")


def _named(notes: DataFrame) -> DataFrame:
    return notes.select(F.col("path").alias("dst"), T.base_name(F.col("path")).alias("key")).distinct()


def link_degrees(notes: DataFrame, compat: bool = False) -> DataFrame:
    """``graph.degrees`` of ``current_links``, ``(path, n_out, n_in)``, from the numbers of links and notes of each name."""
    own, names = materialize(link_names(notes, compat)), _named(notes)
    linking = own.groupBy("key").agg(F.count("*").alias("n"))
    named = names.groupBy("key").agg(F.count("*").alias("n"))
    # A note that links to its own name is no link of either kind.
    itself = own.where(F.col("key") == T.base_name(F.col("src")))
    itself = itself.select(F.col("src").alias("p"), F.lit(-1).cast("long").alias("n_out"), F.lit(-1).cast("long").alias("n_in"))
    zero = F.lit(0).cast("long")
    out = own.join(named, "key").select(F.col("src").alias("p"), F.col("n").alias("n_out"), zero.alias("n_in"))
    into = names.join(linking, "key").select(F.col("dst").alias("p"), zero.alias("n_out"), F.col("n").alias("n_in"))
    sums = out.union(into).union(itself).groupBy("p").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in"))
    return notes.select("path").join(sums, F.col("path") == F.col("p"), "left").drop("p").fillna(0, ["n_out", "n_in"])


def unlinked(pairs: DataFrame, links: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """The pairs of which ``src`` doesn't link to ``dst``: ``links`` has notes ``(src, dst)``, or names ``(src, key)``."""
    if "key" in links.columns:
        own = links.select(F.col("src").alias("__s"), F.col("key").alias("__k"))
        return pairs.join(own, (F.col(src) == F.col("__s")) & (T.base_name(F.col(dst)) == F.col("__k")), "left_anti")
    own = links.select(F.col("src").alias("__s"), F.col("dst").alias("__d"))
    return pairs.join(own, (F.col(src) == F.col("__s")) & (F.col(dst) == F.col("__d")), "left_anti")


def _turn(dim: int) -> np.ndarray:
    """A rotation's first half: what it leaves of a vector is near to half of its square, whatever the vector."""
    return np.linalg.qr(np.random.Generator(np.random.PCG64(1)).standard_normal((dim, dim)))[0][:, : max(1, dim // 2)]


def _halved(m: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The turned half of each vector, and the length of the rest: a product of vectors is at most that of their halves and that of the rests."""
    half = m @ turn
    return half, np.sqrt(np.maximum(0.0, np.einsum("ij,ij->i", m, m) - np.einsum("ij,ij->i", half, half)))


def _matrix(b: pa.RecordBatch, name: str) -> np.ndarray:
    return np.asarray(b.column(name).flatten(), np.float64).reshape(len(b), -1)


def _prints(vectors: DataFrame, turn: np.ndarray, pivots: np.ndarray | None) -> DataFrame:
    """``(path, cell, angle, print, scale, rest, off)``: the half in bytes times ``scale``, which is at most ``off`` away from it; the nearest pivot."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            m = _matrix(b, "vec")
            half, rest = _halved(m, turn)
            scale = (np.abs(half).max(1) / 127).astype(np.float32)
            scale[scale == 0] = 1
            q = np.rint(half / scale[:, None]).astype(np.int8)
            off = np.linalg.norm(half - q * scale[:, None].astype(np.float64), axis=1)
            cell, angle = np.zeros(len(b), np.int32), np.zeros(len(b))
            if pivots is not None:
                far = _angles(m, pivots)
                cell = far.argmin(1).astype(np.int32)
                angle = far[np.arange(len(b)), cell]
            whole = q.tobytes()
            own = pa.array([whole[i : i + q.shape[1]] for i in range(0, len(whole), q.shape[1])], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(cell), pa.array(angle), own, *(pa.array(x.astype(np.float32)) for x in (scale, rest, off))], ["path", "cell", "angle", "print", "scale", "rest", "off"])

    return vectors.select("path", "vec").mapInArrow(each, "path string, cell int, angle double, print binary, scale float, rest float, off float")


def _stripes(cell: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in order of cell and angle as stripes of one cell: where each begins (and the last ends), its cell, smallest and largest angle."""
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    cuts = np.concatenate([np.arange(lo, hi, STRIPE) for lo, hi in zip(first, [*first[1:], len(cell)], strict=True)])
    cuts = np.r_[cuts, len(cell)]
    return cuts, cell[cuts[:-1]], angle[cuts[:-1]], angle[cuts[1:] - 1]


def _reaching(table: pa.Table, min_score: float, apart: np.ndarray) -> pa.Table:
    """Rows of two blocks that may have a partner in the other from ``min_score`` on, and a row without path that says how many products were made.

    Two stripes are left out if by the triangle inequality of angles (to their pivots, which are
    ``apart``) no pair of them can be near enough.  Products are those of prints: no pair is missed,
    few that leave here are none.
    """
    t = table.combine_chunks()
    x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
    home, cell, angle = (t.column(c).to_numpy() for c in ("home", "cell", "angle"))
    own = np.frombuffer(b"".join(t.column("print").to_pylist()), np.int8).reshape(len(t), -1)
    scale, rest, off = (t.column(c).to_numpy() for c in ("scale", "rest", "off"))
    order = np.lexsort((angle, cell))

    def side(block: int) -> tuple[np.ndarray, ...]:
        rows = order[home[order] == block]
        return rows, np.c_[own[rows] * scale[rows, None], rest[rows]].astype(np.float32), off[rows], np.zeros(len(rows), bool), *_stripes(cell[rows], angle[rows])

    made, reach = 0, math.acos(min(1.0, max(-1.0, min_score))) + ANGLE_ERROR
    left = side(x)
    right = left if x == y or not (home == y).any() else side(y)
    if x != y and (right is left or not len(left[0])):
        return pa.table({"x": pa.array([x], pa.int32()), "y": pa.array([y], pa.int32()), "home": pa.array([x], pa.int32()), "path": pa.array([None], pa.string()), "made": pa.array([0], pa.int64())})
    i, a, off_a, met_a, cuts_a, cell_a, low_a, high_a = left
    j, b, off_b, met_b, cuts_b, cell_b, low_b, high_b = right
    for k in range(len(cell_a)):
        theta = apart[cell_a[k], cell_b]
        least = np.maximum(theta - high_a[k] - high_b, np.maximum(low_a[k] - high_b - theta, low_b - high_a[k] - theta))
        near = least <= reach
        if x == y:
            near[:k] = False
        on = np.flatnonzero(np.diff(np.r_[False, near, False].astype(np.int8)))
        rows = slice(cuts_a[k], cuts_a[k + 1])
        for low, high in zip(cuts_b[on[::2]], cuts_b[on[1::2]], strict=True):
            for at in range(low, high, COLUMNS):
                cols = slice(at, min(high, at + COLUMNS))
                hit = a[rows] @ b[cols].T >= np.float32(min_score - off_a[rows].max() - off_b[cols].max() - SLACK)
                made += hit.size
                if x == y and at < rows.stop:  # a pair once, and none of a row with itself
                    later = np.arange(cols.start, cols.stop) > np.arange(rows.start, rows.stop)[:, None]
                    made -= hit.size - int(later.sum())
                    hit &= later
                if (some := hit.any(1)).any():
                    met_a[rows] |= some
                    met_b[cols] |= np.bitwise_or.reduce(hit, 0)
    found = i[met_a] if x == y else np.r_[i[met_a], j[met_b]]
    n = len(found) + 1
    path = pa.concat_arrays([t.column("path").combine_chunks().take(pa.array(found)), pa.array([None], pa.string())])
    return pa.table({"x": pa.array(np.full(n, x, np.int32)), "y": pa.array(np.full(n, y, np.int32)), "home": pa.array(np.r_[home[found], x].astype(np.int32)), "path": path, "made": pa.array(np.r_[np.zeros(n - 1, np.int64), made])})


def _best(s: np.ndarray, ends: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether each score is among the best ``most`` of its end; what ties with the last of them is."""
    order = np.lexsort((-s, ends))
    start = np.flatnonzero(np.r_[True, ends[order][1:] != ends[order][:-1]])
    size = np.diff(np.r_[start, len(s)])
    least = s[order][start + np.minimum(most[ends[order][start]], size) - 1]
    keep = np.empty(len(s), bool)
    keep[order] = s[order] >= np.repeat(least, size)
    return keep


def _exact(batches: Iterator[pa.RecordBatch], min_score: float, top: bool, turn: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks from ``min_score`` on; with ``top`` only those that are among the best ``most`` of one of their notes in a product.

    Vectors stay in the batches that they came in, each held against each; a pair that by its halves may pass is computed whole.
    """
    sides: tuple[list, list] = [], []
    for b in batches:
        x, y, home = b.column("x")[0].as_py(), b.column("y")[0].as_py(), b.column("home").to_numpy()
        m, most = _matrix(b, "vec"), b.column("most").to_numpy() if top else home
        for at, block in enumerate((x,) if x == y else (x, y)):
            if len(rows := np.flatnonzero(home == block)):
                half, rest = _halved(m[rows], turn)
                sides[at].append((b.column("path").take(pa.array(rows)), m[rows], np.c_[half, rest].astype(np.float32), most[rows]))
    same = not sides[1]
    for k, (path_a, a, half_a, most_a) in enumerate(sides[0]):
        for n, (path_b, b, half_b, most_b) in enumerate(sides[0][k:] if x == y else sides[1]):
            for at in range(0, len(a), STRIPE):
                rows = slice(at, min(len(a), at + STRIPE))
                hit = half_a[rows] @ half_b.T >= np.float32(min_score - SLACK)
                if same and not n:
                    hit &= np.arange(len(b)) > np.arange(rows.start, rows.stop)[:, None]
                u, v = np.nonzero(hit) if hit.any() else (np.empty(0, int), np.empty(0, int))
                if len(u) > FEW:
                    s = (a[rows] @ b.T)[u, v]
                else:
                    s = np.einsum("ij,ij->i", a[at + u], b[v])
                keep = s >= min_score
                u, v, s = at + u[keep], v[keep], np.round(s[keep], DECIMALS)
                if top and len(s):
                    keep = _best(s, u, most_a) | _best(s, v, most_b)
                    u, v, s = u[keep], v[keep], s[keep]
                for cut in range(0, len(s), BATCH):
                    one, two = path_a.take(pa.array(u[cut : cut + BATCH])), path_b.take(pa.array(v[cut : cut + BATCH]))
                    swap = pc.greater(one, two)
                    yield pa.RecordBatch.from_arrays([pc.if_else(swap, two, one), pc.if_else(swap, one, two), pa.array(s[cut : cut + BATCH])], ["a", "b", "score"])


_PAIRS = "a string, b string, score double"


def _held(cells: DataFrame, keys: list[str], min_score: float, top: bool, turn: np.ndarray) -> DataFrame:
    """Pairs of each group of ``cells(..., x, y, home, path, vec)`` by ``keys``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _exact(batches, min_score, top, turn)

    return cells.groupBy(*keys).applyInArrow(each, _PAIRS)


def _size(vectors: DataFrame) -> tuple[int, int]:
    n, dim = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    return n, dim or 1


def _met(vectors: DataFrame, n: int, turn: np.ndarray, min_score: float, by_cells: bool) -> tuple[DataFrame, int]:
    """``(x, y, home, path, made)`` of ``_reaching`` over all pairs of blocks that can hold a pair, and how many tasks they are worth.

    Blocks are stretches of the cells in an order in which near pivots follow each other; a large cell is several blocks.
    """
    blocks = max(1, math.ceil(n / BLOCK), min(LEAST_BLOCKS, math.ceil(n / SMALL)))
    long = max(1, math.ceil(n / blocks))
    prints, pivots, sizes, radius = None, np.zeros((1, len(turn))), np.array([n]), np.zeros(1)
    if by_cells:
        number = max(1, min(MAX_PIVOTS, 2 * math.isqrt(n)))
        first = vectors.orderBy(F.xxhash64("path"), "path").limit(PIVOT_SAMPLE * number).select("vec").collect()  # at most PIVOT_SAMPLE * MAX_PIVOTS
        if first:
            pivots = _chained(_spread_out(np.array([r["vec"] for r in first]), number))
        # Kept, so that a vector is in one cell whatever happens to its task.
        prints = materialize(_prints(vectors, turn, pivots))
        sizes, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
        for r in prints.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():  # a row a pivot
            sizes[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    else:
        prints = _prints(vectors, turn, None)
    offset = np.cumsum(sizes) - sizes
    apart = _angles(pivots, pivots) if by_cells else np.zeros((1, 1))
    np.fill_diagonal(apart, 0.0)
    reach = math.acos(min(1.0, max(-1.0, min_score))) + ANGLE_ERROR
    near = apart <= radius[:, None] + radius + reach
    inside = [np.flatnonzero((offset < (k + 1) * long) & (offset + sizes > k * long)) for k in range(blocks)]
    meets = [(x, y) for x in range(blocks) for y in range(blocks) if x == y or near[np.ix_(inside[x], inside[y])].any()]
    spark = vectors.sparkSession
    starts = spark.createDataFrame([(k, int(at), max(1, int(size))) for k, (at, size) in enumerate(zip(offset, sizes, strict=True))], "cell int, offset long, size long")
    others = spark.createDataFrame(meets, "home int, o int")
    homes = prints.join(F.broadcast(starts), "cell").withColumn("home", F.floor((F.col("offset") + F.pmod(F.xxhash64("path"), F.col("size"))) / long).cast("int"))
    dealt = homes.join(F.broadcast(others), "home")  # a row a pair of blocks
    dealt = dealt.select(F.least("home", "o").alias("x"), F.greatest("home", "o").alias("y"), "home", "path", "cell", "angle", "print", "scale", "rest", "off")
    tasks = min(MAX_TASKS, (len(meets) + blocks) // 2)

    def each(t: pa.Table) -> pa.Table:
        return _reaching(t, min_score, apart)

    return dealt.repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(each, "x int, y int, home int, path string, made long"), tasks


def _pairs(vectors: DataFrame, min_score: float, top: bool = False, by_cells: bool = False) -> DataFrame:
    """Prints of 128 bytes or so go to all blocks that can hold a partner; only vectors that may have one there follow."""
    own = vectors.select("path", F.col("vec").cast("array<double>").alias("vec"), *(["most"] if top else []))
    n, dim = _size(own)
    turn = _turn(dim)
    met, tasks = _met(own, n, turn, min_score, by_cells)
    cells = met.where("path is not null").select("x", "y", "home", "path").join(own, "path")
    return _held(cells.repartition(tasks, "x", "y"), ["x", "y"], min_score, top, turn)


def similar_pairs(vectors: DataFrame, min_score: float) -> DataFrame:
    """All ``(a, b, score)`` with ``a < b`` and a cosine of at least ``min_score``, for unit ``vectors(path, vec)``; exact.

    Vectors are dealt to blocks of a bounded number; each pair of blocks is one
    task's matrix product, of half of the dimensions in bytes with a bound of what that
    leaves out.  What the bound can't rule out is computed in double precision.  The
    work grows with the square of the vectors: beyond some millions, see
    ``similar_pairs_hashed``.
    """
    return _pairs(vectors, min_score)


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1.0, 1.0))


def _spread_out(sample: np.ndarray, number: int) -> np.ndarray:
    """Up to ``number`` of the sample, each the farthest from those before it, so that a cluster has one before any has two."""
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < min(number, len(sample)):
        far = int(near.argmin())
        if near[far] > 1 - ANGLE_ERROR:  # copies of those that are chosen
            break
        chosen.append(far)
        near = np.maximum(near, sample @ sample[far])
    return sample[chosen]


def _chained(pivots: np.ndarray) -> np.ndarray:
    """The pivots in an order in which each is followed by the nearest that is left."""
    order, left = [0], np.ones(len(pivots), bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, pivots @ pivots[order[-1]], -np.inf).argmax()))
        left[order[-1]] = False
    return pivots[order]


def similar_pairs_by_cells(vectors: DataFrame, min_score: float) -> DataFrame:
    """``similar_pairs``, exact too, which holds only cells against each other that can hold a pair.

    Up to MAX_PIVOTS vectors, far from each other, are pivots, and a vector belongs to the nearest.  By
    the triangle inequality of angles two cells hold no pair if their pivots are further apart than both
    radiuses and the threshold's angle; so are stripes of a cell, whose vectors are about as far from the pivot.
    Blocks are made of whole cells where they fit, and a vector goes to no more blocks than there are.  How much
    that saves depends on the vectors: see ``cells_report``.
    """
    return _pairs(vectors, min_score, by_cells=True)


def cells_report(vectors: DataFrame, min_score: float) -> DataFrame:
    """One row: all pairs of vectors, and of how many ``similar_pairs_by_cells`` makes the product."""
    own = vectors.select("path", F.col("vec").cast("array<double>").alias("vec"))
    n, dim = _size(own)
    made = _met(own, n, _turn(dim), min_score, True)[0].agg(F.coalesce(F.sum("made"), F.lit(0)).cast("long").alias("compared"))
    return made.select(F.lit(n * (n - 1) // 2).cast("long").alias("pairs"), "compared")


def nearest_pairs(vectors: DataFrame, names: DataFrame, min_score: float, top_k: int = 4) -> DataFrame:
    """Of ``similar_pairs`` those that ``propose_links`` with ``names(src, key)`` can choose from.

    A note's best unlinked ``top_k`` are among its best ``top_k`` and as many
    more as it has linked notes, so a product lets no more of a note's pairs out.
    """
    notes = vectors.groupBy(T.base_name(F.col("path")).alias("key")).agg(F.count("*").alias("n"))
    linked = names.join(notes, "key").groupBy("src").agg(F.sum("n").alias("linked"))
    most = F.least(F.coalesce("linked", F.lit(0)) + top_k, F.lit(1 << 30)).cast("int").alias("most")
    return _pairs(vectors.join(linked, vectors.path == linked.src, "left").select("path", "vec", most), min_score, top=True)


def similar_pairs_hashed(vectors: DataFrame, min_score: float, recall: float = 0.95, bits: int | None = None, seed: int = 1) -> DataFrame:
    """``similar_pairs`` by random hyperplanes: an expected ``recall`` of the pairs at ``min_score``, more of the nearer ones; none below.

    Vectors on the same side of ``bits`` hyperplanes meet, in as many tables as
    the recall asks for; ``bits`` follows the number of vectors.  What meets is
    dealt to blocks as above and computed exactly.
    """
    n, dim = _size(vectors)
    bits = bits or max(4, math.ceil(math.log2(max(2, n / 256))))
    agree = (1 - math.acos(min(1.0, max(-1.0, min_score))) / math.pi) ** bits
    tables = 1 if agree >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - agree))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for b in batches:
            if not len(b):
                continue
            m = np.asarray(b.column(1).flatten(), np.float64).reshape(len(b), -1)
            if planes is None:
                planes = np.random.Generator(np.random.PCG64(seed)).standard_normal((m.shape[1], tables * bits))
            sides = (m @ planes > 0).reshape(len(b), tables, bits)
            keys = sides @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(keys), pa.list_(pa.int64()))], ["path", "vec", "keys"])

    own = vectors.select("path", F.col("vec").cast("array<double>").alias("vec"))
    met = own.mapInArrow(hashed, "path string, vec array<double>, keys array<long>").select("path", "vec", F.posexplode("keys").alias("t", "key"))
    sizes = met.groupBy("t", "key").agg(F.ceil(F.count("*") / SMALL).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = met.join(sizes, ["t", "key"]).withColumn("home", F.pmod(F.xxhash64("path"), F.col("blocks")).cast("int"))
    cells = met.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    cells = cells.select("t", "key", F.least("home", "o").alias("x"), F.greatest("home", "o").alias("y"), "home", "path", "vec")
    pairs = _held(cells, ["t", "key", "x", "y"], min_score, False, _turn(dim))
    return pairs.groupBy("a", "b").agg(F.max("score").alias("score"))


def propose_links(pairs: DataFrame, links: DataFrame, top_k: int = 4) -> DataFrame:
    """``(src, dst, score)``: each note's best ``top_k`` unlinked neighbours, one link a pair, from the shorter name (then path)."""
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "score").union(pairs.select("b", "a", "score"))
    both = unlinked(both, links)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst"))
    best = both.withColumn("r", rank).where(F.col("r") <= top_k)
    pair = best.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))
    first = F.length(T.base_name(F.col("a"))) <= F.length(T.base_name(F.col("b")))
    return pair.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("dst"), "score")


def rank_proposals(proposals: DataFrame) -> DataFrame:
    """With the best score of the note and ``link_rank`` within it; notes by their best, links by score."""
    own = Window.partitionBy("src")
    out = proposals.withColumns({"best": F.max("score").over(own), "link_rank": F.row_number().over(own.orderBy(F.desc("score"), "dst"))})
    return out.orderBy(F.desc("best"), "src", "link_rank")


def apply_links(notes: DataFrame, proposals: DataFrame, max_notes: int = 50) -> DataFrame:
    """``(path, text)`` of the notes that get a section of links: at most ``max_notes``, best first.

    Notes that have the section stay as they are, and links that a note's text
    has already are left out.
    """
    name = lambda p: F.regexp_replace(T.file_name(p), r"\.md$", "")
    both = notes.select("path", "text").where(~F.contains("text", F.lit(SECTION))).join(proposals, F.col("path") == F.col("src"))
    base, full = name(F.col("dst")), F.regexp_replace("dst", r"\.md$", "")
    new = both.where(~F.contains("text", F.concat(F.lit("[["), base, F.lit("]]"))) & ~F.contains("text", F.concat(F.lit("[["), full, F.lit("]]"))))
    per = new.groupBy("path").agg(F.max("score").alias("best"), F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "dst"))).alias("links"))
    per = per.orderBy(F.desc("best"), "path").limit(max_notes)
    lines = F.array_join(F.transform("links", lambda x: F.concat(F.lit("- [["), name(x["dst"]), F.lit("]]"))), "\n")
    section = F.concat(F.regexp_replace("text", r"\s+\z", ""), F.lit(f"\n\n## {SECTION}\n\n"), lines, F.lit("\n"))
    return notes.select("path", "text").join(per, "path").select("path", section.alias("text"))


def near_duplicates(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of which neither links to the other."""
    return unlinked(unlinked(pairs, links, "a", "b"), links, "b", "a")


def canonical_score(path: Column, n_links: Column) -> Column:
    """Higher is more canonical: links, minus 1.5 for each word of a derived note, minus what the name has beyond 20 letters."""
    base = T.base_name(path)
    derived = F.size(F.filter(F.array(*map(F.lit, DERIVED)), lambda w: F.contains(base, w)))
    return n_links.cast("double") - 1.5 * derived - F.greatest(F.lit(0), F.length(base) - 20) / 40


def pick_canonical(pairs: DataFrame, degree: DataFrame, compat: bool = False) -> DataFrame:
    """``(score, canonical, duplicate)``; links are incoming ones, outgoing with ``compat``; a tie goes to the first path."""
    links = degree.select("path", F.col("n_out" if compat else "n_in").alias("n"))
    both = pairs.join(links.select(F.col("path").alias("a"), F.col("n").alias("na")), "a", "left").join(links.select(F.col("path").alias("b"), F.col("n").alias("nb")), "b", "left")
    first = canonical_score(F.col("a"), F.coalesce("na", F.lit(0))) >= canonical_score(F.col("b"), F.coalesce("nb", F.lit(0)))
    return both.select("score", F.when(first, F.col("a")).otherwise(F.col("b")).alias("canonical"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("duplicate"))
