import random

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notelake.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\xa0", "\x85", "'", "'re", "'ll", "1", "²", "é", "漢", "<|endoftext|>", "<|end", "!!", "=", "the", " hello", "　", "😀", "ß", "\r\n", "Ω", "naïve", "x" * 40]


def n(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


def prefixes(text):
    return np.cumsum(np.frombuffer(tokens.counter(PATH).many([text])[0], "<i2")).tolist()


@pytest.mark.parametrize("seed", range(8))
def test_every_prefix(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 14)))
        assert prefixes(text) == [n(text[:i]) for i in range(1, len(text) + 1)], repr(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=24))
def test_any_text(text):
    if not any(0xD800 <= ord(c) < 0xE000 for c in text):
        assert prefixes(text) == [n(text[:i]) for i in range(1, len(text) + 1)]


def test_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    for r in tokens.prefix_counts(df).collect():
        t = texts[r.doc_id]
        assert (r.n_bytes, r.n_tokens, len(r.changes)) == (len(t.encode()), n(t), 2 * len(t))


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_WORDS", 20)
    c = tokens.PrefixCounter(PATH)
    texts = [" ".join(random.Random(i).choices(["alpha", "beta,", "gamma's", "delta", f"w{i}"], k=30)) for i in range(30)]
    got = [int(np.frombuffer(x, "<i2").sum()) for t in texts for x in c.many([t])]
    assert got == [n(t) for t in texts] and len(c.spaced) <= 20


def test_edge_cases(spark):
    long = "word, " * 40_000 + "y" * 3000
    rows = [(1, None, "n"), (1, "", "n"), (None, "Hello there, world", "n"), (4, "Hello there, world", "n"), (5, long, "n")]
    got = tokens.prefix_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"))
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == sorted([(1, 0), (1, 0), (None, n(rows[2][1])), (4, n(rows[2][1])), (5, n(long))], key=str)
    assert tokens.prefix_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").limit(0)).count() == 0
    one = got.where("doc_id = 4").select(tokens.chars_within(F.col("changes"), F.lit(2)).alias("c"), tokens.tokens_at(F.col("changes"), F.lit(5)).alias("t")).first()
    assert one.t == n("Hello") and n("Hello there, world"[: one.c]) <= 2 < n("Hello there, world"[: one.c + 1])
