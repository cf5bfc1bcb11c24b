import random

import numpy as np

from notelake.llm import toxicity

DOCS = "doc_id long, text string, p_toxic double"
LABELS = "doc_id long, quality int, toxic int"


def make(n, seed=0):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randint(20, 200))
        toxic, low = rng.random() < 0.2, rng.random() < 0.2
        for bad, on in ((["vile", "scoundrel", "wretch"], toxic), (["click", "buy", "subscribe"], low)):
            for _ in range(3 if on else 0):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), 0.0))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = make(1500)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:900], LABELS)
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(docs, known).collect()}
    wrong = [i for i, _, t in labels[900:] if got[i] != bool(t)]
    assert len(wrong) <= 6
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in got.items() if not t}


def test_labels_of_other_documents_take_no_places(spark):
    rows, labels = make(400)
    docs = spark.createDataFrame([*rows, *rows[:50], (None, "x", 0.0)], DOCS)
    others = [(1000 + i, i % 2, int(i % 3 == 0)) for i in range(4000)]
    own = spark.createDataFrame(labels, LABELS)
    with_others = spark.createDataFrame(labels + others, LABELS)
    score = lambda y: sorted((r.doc_id or -1, round(r.p_toxic, 9)) for r in toxicity.toxicity(docs, y, sample=300).collect())
    assert score(with_others) == score(own)


def test_later_models_see_held_out_predictions():
    rng = np.random.default_rng(0)
    rows = [np.array(sorted(set(rng.integers(0, 400, 30).tolist()))) for _ in range(600)]
    first = np.array([7 in r for r in rows], int)
    labels = np.stack([first, first], 1)
    models = toxicity.fit_chain(rows, labels)
    assert len(models[1].chain) == 1 and models[0].chain == []
    p = np.array([[0.0], [1.0]])
    assert toxicity.predict_linear(models[1], [set(), set()], p)[1] >= toxicity.predict_linear(models[1], [set(), set()], p)[0]
    noise = rng.integers(0, 2, (600, 2))
    held = toxicity.fit_chain(rows, noise)
    # Noise that can't be predicted out of fold gains little weight in the next model.
    assert abs(held[1].chain[0]) < 3


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (None, "vile", 1.0), (2, "", 1.0), (2, "word " * 100_000, 1.0)], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert [r.toxic for r in toxicity.toxicity(docs, none).collect()] == [False] * 4
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, None), (99, 1, 1), (None, 1, 1)], LABELS)
    assert [r.toxic for r in toxicity.toxicity(docs, one).collect()] == [False] * 4
    assert toxicity.toxicity(docs.limit(0), one).count() == 0 and toxicity.drop_toxic(docs.limit(0), one).count() == 0


def test_sample_is_bounded(spark, monkeypatch):
    rows, labels = make(200)
    seen = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda rows, y, folds=4: seen.append(len(rows)) or [])
    toxicity.train(spark.createDataFrame(rows + rows, DOCS), spark.createDataFrame(labels + labels, LABELS), {"toxic": __import__("pyspark").sql.functions.col("toxic")}, sample=50)
    assert seen == [50]


def dense_chain(rows, labels, asked, folds=4):
    """The chain in plain dense matrices: ``rows`` and ``asked`` are sets of words; probabilities of ``asked``."""
    vocabulary = sorted(set().union(*rows))
    see = lambda group, words: np.array([[w in r for w in words] for r in group], float).reshape(len(group), len(words))

    def fit(group, before, y):
        x, mean = see(group, vocabulary), y.mean()
        n = x.sum(0)
        z = np.abs(x.T @ y - n * mean) / np.sqrt(n * mean * (1 - mean) + 1e-9)
        words = [vocabulary[i] for i in np.argsort(-z, kind="stable")[:500] if n[i] >= 3 and z[i] >= 5]
        x = np.hstack([see(group, words), before, np.ones((len(group), 1))])
        w = np.zeros(x.shape[1])
        prior = (y.sum() + 0.01) / (len(y) + 0.02)
        w[-1] = np.log(prior / (1 - prior))
        rate = 4 * len(y) / (1.05 * np.linalg.norm(x, 2) ** 2)
        v, t = w.copy(), 1.0
        for _ in range(200):
            new = v - rate * x.T @ (1 / (1 + np.exp(-x @ v)) - y) / len(y)
            new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * 2e-5, 0)
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, w, t = new + (t - 1) / after * (new - w), new, after
        return lambda some, before: 1 / (1 + np.exp(-np.hstack([see(some, words), before, np.ones((len(some), 1))]) @ w))

    n = len(rows)
    before, out = np.zeros((n, 0)), np.zeros((len(asked), 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        held = np.zeros(n)
        for f in range(folds):
            own, rest = [i for i in range(n) if i % folds != f], [i for i in range(n) if i % folds == f]
            held[rest] = fit([rows[i] for i in own], before[own], y[own])([rows[i] for i in rest], before[rest])
        out, before = np.c_[out, fit(rows, before, y)(asked, out)], np.c_[before, held]
    return out


def test_against_dense_version(spark):
    rows, labels = make(500, seed=3)
    docs, known = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:400], LABELS)
    words = [set(t.split()) for _, t, _ in rows]
    y = np.array([[t * (1 - q), t * q, t] for _, q, t in labels[:400]])
    want = dense_chain(words[:400], y, words)
    got = {r.doc_id: (r.p_toxic_low_quality, r.p_toxic_high_quality, r.p_toxic) for r in toxicity.toxicity(docs, known).collect()}
    assert np.abs(np.array([got[i] for i, _, _ in rows]) - want).max() < 0.02
