import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from tokenizers import Tokenizer

from notelake.llm import packing

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]


def check(rows, texts, length=2048):
    """Every text's ids are covered once, in order; sequences are gapless and within their length."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        own, at = ids(texts[doc]), 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            part = own[r.start : r.start + r.length]
            assert (r.piece, r.start) == (k, at) and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
            assert r.length == length or r.start + r.length == len(own)
            at += r.length
        assert at == len(own) and (len(own) > length or len(pieces) == 1)
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by_seq), sum(r.length for r in rows)


def test_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = packing.pack_documents(df).collect()
    sequences, total = check(rows, {r.doc_id: r.text for r in df.collect()})
    assert sequences <= -(-total // 2048) * 1.02 + 1


def test_words_alone_are_words_in_texts():
    encode = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).encode
    texts = ["", " ", "It's  a\ttest\n\nof “words”, naïve １２ ﬁ", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΟΔΟΣ", "é ́x", "漢字 テスト", "x" * 5000, "a b c\x1cd"]
    assert [np.frombuffer(g, "<u4").tolist() for g in encode(texts)] == [ids(t)[:-1] for t in texts]


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 60, 400)
    cap = (100.0, 4.0, 4000.0)
    bins, offset = packing.vector_best_fit(lengths, cap, (1.0, 1.0, 1.0), rule)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        assert lengths[own].sum() <= 100 and len(own) <= 4 and (lengths[own].astype(float) ** 2).sum() <= 4000
        order = own[np.argsort(offset[own])]
        assert (offset[order] == np.r_[0, np.cumsum(lengths[order])[:-1]]).all()


def test_best_fit_is_the_best_fit():
    lengths = np.array([60, 50, 45, 40, 35, 30, 10])
    bins, _ = packing.vector_best_fit(lengths, (100.0, 100.0, 1e9), (1.0, 0.0, 0.0))
    left: list[int] = []
    want = []
    for x in lengths:  # one by one, over all bins
        fits = [(room - x, i) for i, room in enumerate(left) if room >= x]
        if fits:
            i = min(fits)[1]
        else:
            left.append(100)
            i = len(left) - 1
        left[i] -= x
        want.append(i)
    assert bins.tolist() == want


def test_edge_cases(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "hello there", 5), (3, "word " * 9000, 5), (3, "again", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack_documents(df).collect()
    assert sum(r.length for r in got) == sum(len(ids(t)) for _, t, _ in rows)
    assert packing.pack_documents(df.limit(0)).count() == 0
    kept = packing.pieces(df, keep_ids=True).where("doc_id = 2").first()
    assert kept.ids == b"\0\0\0\0" and kept.length == 1
    limited = packing.pack(packing.pieces(df), max_docs=2).groupBy("sequence_id").count().collect()
    assert max(r["count"] for r in limited) <= 2


def test_clashing_columns_are_replaced(spark):
    df = packing.pieces(spark.createDataFrame([(i, "some words " * i) for i in range(20)], "doc_id long, text string"))
    from pyspark.sql import functions as F

    had = df.select("*", F.lit("x").alias("sequence_id"), F.lit(9).alias("offset"), F.lit(1).alias("__shard"), F.lit("kept").alias("lang"))
    got = packing.pack(had, max_docs=3).collect()
    assert len(got) == 20 and {r.lang for r in got} == {"kept"}
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert len(own) <= 3 and [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]


def test_pieces_in_use_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 1000)
    own = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    asked = []

    class Counting:
        def encode_batch_fast(self, texts, **how):
            asked.extend(w for t in texts for w in t.split(" "))
            return LIBRARY.encode_batch_fast(texts, **how)

    own.tokenizer = Counting()
    names = ["".join(chr(97 + int(d)) for d in str(i)) for i in range(20_000)]
    common, rare, marks = names[:100], iter(names[100:]), ".,;:?!/&%#+=*~^|@$_-"
    for mark in marks:  # the common pieces stand in words that are new each time, among rare ones
        texts = [" ".join(w + mark for w in common), " ".join(next(rare) for _ in range(200)), "naïve “ΟΔΟΣ”"]
        assert [np.frombuffer(g, "<u4").tolist() for g in own.encode(texts)] == [ids(t)[:-1] for t in texts]
    assert max(asked.count(w) for w in common) == 1
    assert len(asked) < 200 * len(marks) + 1000


def test_tokens_of_a_text_stay_together_when_kinds_alternate():
    encode = packing.WordIds(public_tokenizers.path("word_bpe_49k.json")).encode
    texts = ["don't  stop", "“don't” stop", "", "漢字", "12,5\t% it's'd", " \n", "\t", "é’s", "x'll\r\ny", "a　b"]
    for part in (texts, texts[::-1], ["\t"], [], ["漢字"], [" "]):
        assert [np.frombuffer(g, "<u4").tolist() for g in encode(part)] == [ids(t)[:-1] for t in part]
