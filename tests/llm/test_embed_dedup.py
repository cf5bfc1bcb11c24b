import numpy as np
import pytest

from notelake.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>"


def slow(rows, threshold=0.9):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, np.float32).astype(float)
    link = {k: set() for k in range(len(rows))}
    for a, x in good.items():
        for b, y in good.items():
            if a < b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                link[a].add(b)
                link[b].add(a)
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in link[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        c = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((i, len(link[k]), c, c is None or i == c))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in embed_dedup.embedding_components(df).collect()), key=str)


@pytest.mark.parametrize("block", [8192, 40])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for c in rng.normal(size=(12, 16)):
        for _ in range(25):
            rows.append((len(rows) * 3 % 1000, (c + rng.normal(size=16) * rng.choice([0.01, 0.3, 0.5])).tolist()))
    rows += [(2000 + i, rows[0][1]) for i in range(50)] + [(3000, [2 * x for x in rows[0][1]])]
    assert got(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_bounds_are_rigorous():
    rng = np.random.default_rng(2)
    for scale in (1.0, 1e-3):
        a, b = (rng.normal(size=(300, 48)) * np.where(rng.random((300, 48)) < 0.1, 1, scale) for _ in range(2))
        a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
        (qa, sa, ea, ma), (qb, sb, eb, _) = embed_dedup.quantise(a), embed_dedup.quantise(b)
        near = (qa.astype(int) @ qb.T.astype(int)) * sa[:, None] * sb[None, :]
        assert (np.abs(near - a @ b.T) <= ea[:, None] + ma[:, None] * eb[None, :]).all()
        for t in (0.1, 0.3):
            x, y = embed_dedup.tile_links(a, b, t, False)
            assert set(zip(x.tolist(), y.tolist(), strict=True)) == set(zip(*(v.tolist() for v in np.nonzero(a @ b.T >= t)), strict=True))


def test_edge_cases(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [1.0, None, 3.0]), (6, [1.0, float("nan"), 3.0]), (7, [float("inf"), 1.0, 1.0]), (None, v), (8, v), (8, v), (9, [1.0, 2.0]), (10, [-x for x in v]), (11, [1e-30, 2e-30, 3e-30]), (12, [1e30, 2e30, 3e30])]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA + ", n_links string, n int")
    assert got(df) == slow(rows)
    assert got(df.limit(0)) == []


def test_tasks_are_bounded_and_many(spark, monkeypatch):
    """Some cells a core where there are vectors enough, and never more tasks than MAX_TASKS."""
    rng = np.random.default_rng(4)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(600, 8)).tolist())]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(embed_dedup, "SMALL_BLOCK", 50)
    want = slow(rows)
    assert got(df) == want
    monkeypatch.setattr(embed_dedup, "MAX_TASKS", 3)
    assert got(df) == want


def test_rows_that_share_an_id(spark):
    """Vectors of one id that are unlike stay apart, and none takes the other's links; links between rows of one id count."""
    v = [1.0, 0.0]
    rows = [(1, v), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (2, [1.0, 0.02]), (3, [-1.0, 0.0]), (3, [-1.0, 0.01]), (3, v)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == slow(rows)
    rng = np.random.default_rng(8)
    rows = [(int(rng.integers(40)), (c + rng.normal(size=8) * 0.2).tolist()) for c in rng.normal(size=(30, 8)) for _ in range(6)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == slow(rows)
    import duckdb

    from notelake.llm import sql

    d = duckdb.connect()
    d.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    d.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted((tuple(r) for r in d.execute(sql.OP8).fetchall()), key=str) == slow(rows)
