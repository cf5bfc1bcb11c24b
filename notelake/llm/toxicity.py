"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other; each category's model sees the
text and the probabilities of the categories before it.  In training those are
out-of-fold predictions, so a later model sees them as they will be on new text.
Models are logistic regressions with an L1 penalty on the presence of words
(hashed), so long texts don't gather noise from thousands of small weights.

Training takes a bounded sample of labelled rows (``sample``, by default
10,000: those with the smallest hash of their id).  Spark counts the sample's
words by fold and label and chooses those that some model of the chain may look
at; of each row only these come to the driver, whatever the length of its text.
Scoring runs over all rows, one pass, no shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

SAMPLE, FOLDS, BITS = 10_000, 4, 20
#: Words a model looks at: those in at least MIN_DOCS rows whose presence tells most, from MIN_Z standard deviations
#: on (among a million words that tell nothing, none is expected beyond it).
FEATURES, MIN_DOCS, MIN_Z = 500, 3, 5.0
PENALTY, ROUNDS = 2e-5, 200
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_hashes(text: str | None) -> set[int]:
    """Hashes of the distinct words of a whole text, lower-cased."""
    mask = (1 << BITS) - 1
    return {zlib.crc32(w.encode("utf-8", "surrogatepass")) & mask for w in set(_WORD.findall((text or "").lower()))}


@dataclass
class Linear:
    """Bias, weights of word hashes, weights of the chain's probabilities before."""

    bias: float
    words: dict[int, float] = field(default_factory=dict)
    chain: list[float] = field(default_factory=list)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(x: np.ndarray, y: np.ndarray, penalty: float, prior: float) -> np.ndarray:
    """Accelerated proximal gradient steps; the last column is the bias, which isn't penalised."""
    n, w = len(y), np.zeros(x.shape[1], np.float32)
    w[-1] = np.log(prior / (1 - prior))
    v, step, t = w.copy(), np.ones(x.shape[1], np.float32), 1.0
    for _ in range(10):  # the largest eigenvalue of the curvature, by powers
        step = x.T @ (x @ step)
        norm = np.linalg.norm(step)
        step = step / norm
    rate = 4 * n / (1.05 * norm)
    for _ in range(ROUNDS):
        new = v - rate * (x.T @ (_sigmoid(x @ v) - y).astype(np.float32)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = (new + (t - 1) / t_new * (new - w)).astype(np.float32), new.astype(np.float32), t_new
    return w


def fit_linear(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray) -> Linear:
    """L1 logistic regression; ``before``: rows x earlier categories.

    Without rows it predicts 0; with one class, close to that class.
    """
    n = len(y)
    if not n:
        return Linear(-30.0, {}, [0.0] * before.shape[1])
    prior = (y.sum() + 0.01) / (n + 0.02)
    if y.min() == y.max():
        return Linear(float(np.log(prior / (1 - prior))), {}, [0.0] * before.shape[1])
    every = np.concatenate(rows) if rows else np.empty(0, np.int32)
    size = np.array([len(r) for r in rows])
    label = np.repeat(y, size)
    ids, at, count = np.unique(every, return_inverse=True, return_counts=True)
    hits = np.bincount(at, label, len(ids))
    mean = y.mean()
    tells = np.abs(hits - count * mean) / np.sqrt(count * mean * (1 - mean) + 1e-9)
    tells[count < MIN_DOCS] = 0
    top = np.argsort(-tells, kind="stable")[:FEATURES]
    top = np.sort(top[tells[top] >= MIN_Z])
    place = np.full(len(ids) + 1, -1)
    place[top] = np.arange(len(top))
    x = np.zeros((n, len(top) + before.shape[1] + 1), np.float32)
    col, row = place[at], np.repeat(np.arange(n), size)
    x[row[col >= 0], col[col >= 0]] = 1
    x[:, len(top) : -1] = before
    x[:, -1] = 1
    w = _descend(x, y, PENALTY, prior)
    words = {int(ids[i]): float(c) for i, c in zip(top, w[: len(top)], strict=True) if c}
    return Linear(float(w[-1]), words, [float(c) for c in w[len(top) : -1]])


def predict_linear(model: Linear, rows: list, before: np.ndarray) -> np.ndarray:
    z = np.array([sum(map(model.words.get, model.words.keys() & r)) for r in rows], float)
    return _sigmoid(z + model.bias + before @ np.array(model.chain, float).reshape(before.shape[1]))


def predict_rows(model: Linear, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
    """As ``predict_linear``, for sorted arrays of hashes."""
    ids = np.array(sorted(model.words), np.int64)
    weight = np.array([model.words[i] for i in ids.tolist()] + [0.0])
    every, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    at = np.searchsorted(ids, every)
    at[(at == len(ids)) | (np.append(ids, -1)[at] != every)] = len(ids)
    z = np.bincount(row, weight[at], len(rows))
    return _sigmoid(z + model.bias + before @ np.array(model.chain, float).reshape(before.shape[1]))


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """A model a column of ``labels``, in order.  Row i is held out in fold i mod ``folds``."""
    n, k = labels.shape
    if n:  # words in too few rows can't be chosen anyhow
        ids, count = np.unique(np.concatenate(rows), return_counts=True)
        ids = np.append(ids[count >= MIN_DOCS], 1 << BITS).astype(np.int32)
        rows = [r[ids[np.searchsorted(ids, r)] == r] for r in rows]
    before, models, fold = np.zeros((n, 0)), [], np.arange(n) % folds
    for c in range(k):
        y = labels[:, c].astype(float)
        models.append(fit_linear(rows, before, y))
        if c + 1 < k:
            held = np.zeros(n)
            for f in range(min(folds, n)):
                out, own = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
                m = fit_linear([rows[i] for i in own], before[own], y[own])
                held[out] = predict_rows(m, [rows[i] for i in out], before[out])
            before = np.c_[before, held]
    return models


def predict_chain(models: list[Linear], texts) -> np.ndarray:
    """Probabilities, texts x categories; one text's words are held at a time."""
    out = []
    for t in texts:
        words, p = word_hashes(t), np.zeros((1, 0))
        for m in models:
            p = np.c_[p, predict_linear(m, [words], p)]
        out.append(p[0])
    return np.array(out).reshape(len(out), len(models))


def _looked_at(rows: DataFrame, names: list[str], folds: int = FOLDS) -> set[int]:
    """Of ``rows(ids, fold, names)`` the hashes that a model of the chain may look at: at most FEATURES a model and fold."""
    totals = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names)).collect()}
    sums = [F.count_if(F.col("fold") == f).alias(f"n{f}") for f in totals] + [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in totals for c in names]
    if not totals:
        return set()
    words = materialize(rows.select(F.explode("ids").alias("w"), "fold", *names).groupBy("w").agg(*sums))
    best = []
    for c in names:
        for out in [None, *totals] if c != names[-1] else [None]:  # the last link has no use for predictions out of fold
            own = [f for f in totals if f != out]
            n, mean = sum(totals[f]["n"] for f in own), 0.0
            if n:
                mean = sum(totals[f][c] for f in own) / n
            if not 0 < mean < 1:
                continue
            count, hits = (sum((F.col(x.format(f)) for f in own), F.lit(0)) for x in ("n{}", c + "_{}"))
            tells = F.abs(hits - count * mean) / F.sqrt(count * (mean * (1 - mean)) + 1e-9)
            told = words.select("w", F.when(count >= MIN_DOCS, tells).alias("tells")).where(F.col("tells") >= MIN_Z)
            best.append(told.orderBy(F.desc("tells"), "w").limit(FEATURES).select("w"))
    every = best[0] if best else words.limit(0).select("w")
    for more in best[1:]:
        every = every.union(more)
    return {r["w"] for r in every.distinct().collect()}


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> list[Linear]:
    """Chain over ``categories`` (name -> 0/1 column of ``labels``) from at most ``sample`` labelled rows of ``docs``.

    The sample is drawn by the hash of the id among all ids that have both a
    label and a document, so labels of other documents take no places in it.
    Labels repeated for an id count as 1 if any is; rows with a null label, and
    labels without a document, teach nothing.  Of rows that repeat an id one
    teaches.  A null text has no words.
    """
    names = [f"y{i}" for i in range(len(categories))]
    y = labels.select(F.col("doc_id").cast("long").alias("k"), *(c.cast("int").alias(n) for n, c in zip(names, categories.values(), strict=True))).dropna()
    y = y.groupBy("k").agg(*(F.max(n).alias(n) for n in names))
    # Each id once, so that one which many rows share is one row here; both sides are dealt by id already.
    here = docs.select(F.col("doc_id").cast("long").alias("k")).where("k is not null").distinct()
    y = y.join(here, "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(sample)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([sorted(word_hashes(t.as_py())) for t in b.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, *b.columns[2:]], ["k", "ids", *names])

    # The sample's number of rows is bounded, so is its broadcast, and so are the windows over it.
    d = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").alias("t")).join(F.broadcast(y), F.col("d") == F.col("k"))
    schema = ", ".join(["k long", "ids array<int>", *(f"{c} int" for c in names)])
    d = d.select("k", "t", *names).mapInArrow(hashed, schema)
    d = d.groupBy("k").agg(F.min(F.struct("ids", *names)).alias("s")).select("k", "s.*")
    rows = materialize(d.withColumn("fold", (F.row_number().over(Window.orderBy("k")) - 1) % FOLDS))
    used = np.array(sorted(_looked_at(rows, names)), np.int32)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([np.intersect1d(np.asarray(x.values, np.int32), used, True).astype("<i4").tobytes() for x in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, *b.columns[2:]], ["k", "ids", *names])

    got = rows.select("k", "ids", *names).mapInArrow(kept, schema.replace("array<int>", "binary")).collect()
    got = sorted(((r["k"], bytes(r["ids"]), [r[c] for c in names]) for r in got), key=lambda r: r[0])
    y = np.array([r[2] for r in got], np.int64).reshape(len(got), len(names))
    return fit_chain([np.frombuffer(r[1], "<i4") for r in got], y)


def scores(models: list[Linear], text: Column) -> Column:
    """The chain's probabilities of a text, an array of doubles in the categories' order; a null text is empty."""

    @F.pandas_udf("array<double>")
    def score(t: pd.Series) -> pd.Series:
        return pd.Series(list(predict_chain(models, t)))

    return score(text)


def categories_of(labels: DataFrame) -> dict[str, Column]:
    """The chain over the supplied labels: toxic rows of low and of high quality, then toxic rows, which both tell of.

    The labels say no more of a row than its quality and whether it is toxic.
    """
    toxic, good = labels["toxic"], labels["quality"]
    return {"toxic_low_quality": toxic * (1 - good), "toxic_high_quality": toxic * good, "toxic": toxic}


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, p_toxic_low_quality, p_toxic_high_quality, p_toxic, toxic)`` of every row of ``docs``; other columns are left out.

    Without labels nothing is toxic.  A null text is empty.  Ids may be null or
    repeat: each row is answered by its text, equal texts alike.
    """
    categories = categories_of(labels)
    models, names = train(docs, labels, categories, sample), [f"p_{c}" for c in categories]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = predict_chain(models, (t.as_py() for t in b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in p.T), pa.array(p[:, -1] >= threshold)], ["doc_id", *names, "toxic"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return known.mapInArrow(each, ", ".join(["doc_id long", *(f"{c} double" for c in names), "toxic boolean"]))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` below the threshold; columns as they came.

    A row is judged by its text alone, so repeated rows, and rows without an id,
    stay or go like any other; an empty or null text stays unless most labelled
    rows are toxic.  No rows in, no rows out; without labels all stay.
    """
    models = train(docs, labels, categories_of(labels), sample)
    return docs.where(F.element_at(scores(models, docs["text"]), -1) < threshold)
