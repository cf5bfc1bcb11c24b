"""Search against plain Python versions, over the smallest tables; pairs of similar notes by blocks and by hashing."""

import math
import random
import re

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from notelake.functions import text as T
from notelake.functions import vectors as V
from notelake.jobs import queries, views
from notelake.operators import notes, retrieval, similarity

TOKEN = re.compile(T.TOKEN)


def key_terms(query):
    tokens = TOKEN.findall(query.lower())
    return sorted({t for t in tokens if len(t) > 1 and t not in T.STOP_WORDS} or set(tokens))


@pytest.fixture(scope="module")
def index(spark):
    from notelake.functions import chunking
    from notelake.operators.index import embed_with_cache

    v = views.vault_notes(spark, DATA)
    chunks = chunking.chunk_notes_index(v).withColumn("t", T.embed_text(F.col("path"), F.col("heading"), F.col("text")))
    return queries.checkpoint(embed_with_cache(chunks, "t", spark.createDataFrame([], "h string, vec array<float>"), V.hashing_embedder)[0].drop("t"))


def slow_search(chunks, asked, k):
    import pandas as pd

    tokens = [TOKEN.findall(c.text.lower()) for c in chunks]
    df = {}
    for ts in tokens:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = {}
    for qid, query in asked:
        terms = key_terms(query)
        if not terms:
            continue
        idf = {t: math.log(1 + len(chunks) / (1 + df.get(t, 0))) for t in terms}
        weight = sum(idf.values()) / len(idf) / max(idf.values())
        q = V.hashing_embedder(pd.Series([f":: {query}"]))[0].astype(float)
        hits = []
        for c, ts in zip(chunks, tokens, strict=True):
            if not ts or c.vec is None:
                continue
            v = np.array(c.vec, float)
            norm = np.linalg.norm(v) * np.linalg.norm(q)
            sem = min(1.0, max(0.0, float(v @ q) / norm)) if norm else 0.0
            score = 0.6 * min(1.0, sum(t in terms for t in ts) / len(ts)) * weight + 0.4 * sem
            if any(t in f"{c.path} {c.heading or ''}".lower() for t in terms):
                score *= 1.35
            score += {1: 0.15, 2: 0.10}.get(c.hlevel, 0.0)
            hits.append((-score, c.path, c.ord, sem))
        out[qid] = sorted(hits)[:k]
    return out


@pytest.mark.parametrize("batch", [10_000, 7])
def test_index_search(spark, index, monkeypatch, batch):
    monkeypatch.setattr(retrieval, "MAX_QUERIES", batch)
    monkeypatch.setattr(retrieval, "QUERY_TILE", 3)
    asked = views.queries(spark, DATA)
    got = {}
    for r in retrieval.index_search(asked, index, retrieval.doc_freq(index), index.count(), V.hashing_embedder).collect():
        got.setdefault(r.qid, []).append((r.rank, r.score, r.sem, r.path, r.ord))
    want = slow_search(index.collect(), [tuple(r) for r in asked.collect()], 5)
    assert set(got) == set(want)
    for qid, hits in want.items():
        mine = sorted(got[qid])
        assert [round(s, 6) for _, s, *_ in mine] == [round(-s, 6) for s, *_ in hits]
        # Scores that differ in the last digits only may change places.
        assert sum((p, o) == (h[1], h[2]) for (*_, p, o), h in zip(mine, hits, strict=True)) >= len(hits) - 2


def test_relevance_floor(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a.md", None, "has docker", 0.1), (1, 2, "b.md", None, "x", 0.0), (2, 1, "a.md", None, "nothing", 0.61), (3, 1, "c.md", None, "nothing", 0.62), (4, 1, "part.md", None, "99315", 0.2), (5, 1, "z.md", "Full Query", "x", None)],
        "qid long, rank int, path string, heading string, text string, sem double",
    )
    asked = spark.createDataFrame([(1, "docker"), (2, "other"), (3, "other"), (4, "993"), (5, " full query ")], "qid long, query string")
    assert sorted({r.qid for r in retrieval.relevance_floor(hits, asked).collect()}) == [1, 3, 4, 5]


@pytest.mark.parametrize(
    "row,want",
    [
        (dict(level=1, heading="docker", age=0.0, back=0, kind="prose"), 0.15 + 0.20 * 0.5 + 0.10),
        (dict(level=2, heading=None, age=60.0, back=50, kind="code"), 0.10 + 0.10 / math.e + 0.08 + 0.02),
        (dict(level=3, heading="docker backup x", age=None, back=None, kind="list"), 0.05 + 0.20 + 0.01),
        (dict(level=0, heading="", age=-5.0, back=3, kind="table"), 0.10 + 0.08 * math.log(4) / math.log(51) + 0.02),
    ],
)
def test_boosts(spark, row, want):
    df = spark.createDataFrame([(row["level"], row["heading"], row["age"], row["back"], row["kind"], ["docker", "backup"])], "level int, heading string, age double, back long, kind string, terms array<string>")
    got = df.select(retrieval.boost(F.col("level"), F.col("heading"), F.col("terms"), F.col("age"), F.col("back"), F.col("kind")).alias("v")).first().v
    assert got == pytest.approx(want)


def test_hybrid_and_names(spark):
    df = spark.createDataFrame([(0.5, 0.25, "My Docker.md", ["docker"]), (0.5, None, "x.md", ["x"]), (0.5, -1.0, "x.md", [])], "s double, c double, name string, terms array<string>")
    got = df.select(retrieval.hybrid(F.col("s"), F.col("c")).alias("h"), retrieval.name_boost(F.col("name"), F.col("terms")).alias("n")).collect()
    assert [(round(r.h, 6), r.n) for r in got] == [(0.4, 1.35), (0.5, 1.0), (0.3, 1.0)]


def test_all_notes_of_a_name_are_candidates(spark):
    v = spark.createDataFrame([(f"docker {i:02d}.md", "text") for i in range(25)], "path string, text string")
    asked = spark.createDataFrame([(1, "docker")], "qid long, query string")
    got = retrieval.candidates(retrieval.expand_query(asked, synonyms={"none": []}), v).collect()
    assert len(got) == 25 and sorted(r.stage for r in got) == [1] * 20 + [2] * 5


def test_search_names_by_grams(spark):
    v = spark.createDataFrame([("A/Über docker.md",), ("b/Dock.md",), ("dokker.md",), ("c/docker/docker.md",)], "path string")
    asked = spark.createDataFrame([(1, "DOCKER"), (2, "d"), (3, ""), (4, "docker.md"), (5, None)], "qid long, query string")
    got = {}
    for r in notes.search_names(v, asked, 3).collect():
        got.setdefault(r.qid, []).append((r.rank, r.path))
    assert {q: [p for _, p in sorted(x)] for q, x in got.items()} == {1: ["A/Über docker.md", "c/docker/docker.md"], 2: ["A/Über docker.md", "b/Dock.md", "c/docker/docker.md"], 4: ["A/Über docker.md", "c/docker/docker.md"]}


def _vectors(spark, n=400, near=0.25):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 24))
    m = centers[rng.integers(0, 40, n)] + near * rng.normal(size=(n, 24))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m, spark.createDataFrame([(f"n{i:03d}.md", v) for i, v in enumerate(m.tolist())], "path string, vec array<double>")


def test_pairs_by_blocks_and_by_hashing(spark, monkeypatch):
    m, df = _vectors(spark)
    score = m @ m.T
    want = {(f"n{i:03d}.md", f"n{j:03d}.md") for i in range(len(m)) for j in range(i + 1, len(m)) if score[i, j] >= 0.78}
    monkeypatch.setattr(similarity, "BLOCK", 60)
    assert {(r.a, r.b) for r in similarity.similar_pairs(df, 0.78).collect()} == want
    found = [(r.a, r.b) for r in similarity.similar_pairs_hashed(df, 0.78, bits=7).collect()]
    assert len(found) == len(set(found)) and set(found) <= want and len(found) >= 0.9 * len(want) > 100


def test_best_pairs_are_enough_for_proposals(spark, monkeypatch):
    m, df = _vectors(spark)
    rng = random.Random(3)
    names = spark.createDataFrame([(f"n{rng.randrange(400):03d}.md", f"n{rng.randrange(400):03d}") for _ in range(300)], "src string, key string").distinct()
    monkeypatch.setattr(similarity, "BLOCK", 200)
    every = similarity.propose_links(similarity.similar_pairs(df, 0.6), names, 2).collect()
    few = similarity.nearest_pairs(df, names, 0.6, 2)
    plain = lambda rows: sorted((r.src, r.dst, round(r.score, 9)) for r in rows)
    assert plain(similarity.propose_links(few, names, 2).collect()) == plain(every)
    assert few.count() < similarity.similar_pairs(df, 0.6).count()


@pytest.mark.parametrize(("spread", "block"), [(0.1, 4096), (0.1, 40), (3.0, 4096), (0.5, 60)])
def test_pairs_by_cells(spark, monkeypatch, spread, block):
    """The pairs of all pairs, on clustered and on random vectors; on clustered ones most products aren't made."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "STRIPE", 16)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(25, 24))
    m = np.array([centres[i % 25] + spread * rng.normal(size=24) for i in range(500)] + [centres[0]] * 30)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = queries.checkpoint(spark.createDataFrame([(f"n{i:04}", v.tolist()) for i, v in enumerate(m)], "path string, vec array<double>"))
    for least in (0.78, 0.4):
        product = m @ m.T
        want = {(f"n{i:04}", f"n{j:04}") for i, j in zip(*np.nonzero(np.triu(product >= least, 1)), strict=True)}
        got = [(r.a, r.b) for r in similarity.similar_pairs_by_cells(df, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want
    report = similarity.cells_report(df, 0.78).first()
    assert report.pairs == len(m) * (len(m) - 1) // 2 >= report.compared
    if spread == 0.1:
        assert report.compared < 0.3 * report.pairs
    assert similarity.similar_pairs_by_cells(df.limit(0), 0.78).count() == 0


def test_similar_notes_have_similar_wording(spark):
    """Pairs aren't tied to neighbouring ids, and exact copies of documents are among them."""
    pairs = {(r.a, r.b): r.score for r in queries.l4_similar_pairs(spark, DATA).collect()}
    v = {r.path: r for r in views.filed_notes(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.col("text").alias("body")), "doc_id").collect()}
    assert pairs and all(not p.startswith(("05-", "03-")) for ab in pairs for p in ab)
    def shingles(text):
        words = TOKEN.findall(text.lower())
        return {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
    for a, b in pairs:
        x, y = shingles(v[a].body), shingles(v[b].body)
        assert len(x & y) > 0.4 * min(len(x), len(y))
    assert any(abs(v[a].doc_id - v[b].doc_id) > 9 for a, b in pairs)


def test_pairs_go_to_a_bounded_number_of_blocks(spark, monkeypatch):
    """A vector goes to no more blocks than there are, whatever the number of cells, and only rows that may have a partner leave a block with their vectors."""
    monkeypatch.setattr(similarity, "BLOCK", 100)
    rng = np.random.default_rng(5)
    m = rng.normal(size=(600, 256))
    m[300:310] = m[:10] + 0.1 * rng.normal(size=(10, 256))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = queries.checkpoint(spark.createDataFrame([(f"n{i:03}", v.tolist()) for i, v in enumerate(m)], "path string, vec array<double>"))
    for by_cells in (False, True):
        rows = similarity._met(df, 600, similarity._turn(256), 0.78, by_cells)[0].collect()
        assert len({(r.x, r.y) for r in rows}) <= 6 * 7 // 2
        assert {f"n{i:03}" for i in [*range(10), *range(300, 310)]} <= {r.path for r in rows if r.path} and sum(r.path is not None for r in rows) < 100
        made = sum(r.made for r in rows)
        assert made <= 600 * 599 // 2 and (by_cells or made == 600 * 599 // 2)


def test_unit_computes_the_norm_once(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(V.unit(F.col("v")).alias("u"))
    assert [r.u for r in df.collect()] == [[0.6, 0.8], None]
    assert df._jdf.queryExecution().analyzed().toString().lower().count("sqrt") == 1


def test_many_pairs_of_copies(spark, monkeypatch):
    """Dense products, and the best pairs of a product: all that tie with the last that counts."""
    monkeypatch.setattr(similarity, "BLOCK", 50)
    monkeypatch.setattr(similarity, "STRIPE", 32)
    monkeypatch.setattr(similarity, "FEW", 20)
    df = spark.createDataFrame([(f"n{i:03}", [0.6, 0.8, 0.0] if i % 2 else [1.0, 0.0, 0.0]) for i in range(200)], "path string, vec array<double>")
    got = [tuple(r) for r in similarity.similar_pairs(df, 0.78).collect()]
    assert len(got) == len(set(got)) == 2 * (100 * 99 // 2) and all(a < b and s == 1.0 for a, b, s in got)
    assert similarity.similar_pairs_by_cells(df, 0.6).count() == 200 * 199 // 2
    names = spark.createDataFrame([], "src string, key string")
    few = similarity.nearest_pairs(df, names, 0.6, 2)
    assert few.where("score = 1").count() == len(got) and few.where("score < 1").count() < 1000  # of 10,000
