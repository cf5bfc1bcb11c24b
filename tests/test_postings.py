"""Postings against searches over all chunks, and the streamed index against the batch build."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from notelake import schema
from notelake.functions import chunking
from notelake.functions import vectors as V
from notelake.operators import index, postings, retrieval
from notelake.shared import materialize as checkpoint
from notelake.sources.notes import read_index, write_index
from notelake.streaming.index_stream import EVENTS, changes, current_index

NOW = dt.datetime(2024, 1, 13)
DAY = dt.datetime(2024, 1, 1)


def test_classes_hold_their_numbers(spark):
    got = spark.range(1, 5000).select(F.col("id"), postings.class_of(F.col("id")).alias("c")).select("id", "c", postings.low_of(F.col("c")).alias("low"), postings.high_of(F.col("c")).alias("high")).collect()
    assert all(r.low <= r.id <= r.high for r in got)
    assert [(r.low, r.high) for r in got if r.id in (8, 9, 17, 18, 36)] == [(8, 8), (9, 17), (9, 17), (18, 35), (36, 71)]


@pytest.fixture(scope="module")
def corpus(spark):
    """A term that stands in every chunk, frequent ones and rare ones; numbers of places on both sides of a class's end."""
    rng = random.Random(4)
    rows = []
    for i in range(400):
        words = ["common"] * rng.choice([1, 1, 1, 2, 3, 8, 9, 17, 18, 40]) + rng.choices([f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(40)], k=rng.randint(1, 60))
        rng.shuffle(words)
        rows.append((f"n{i // 3}.md", i % 3, " ".join(words)))
    rows += [("empty.md", 0, ""), ("null.md", 0, None), ("punctuation.md", 0, "-- !!")]
    return checkpoint(spark.createDataFrame(rows, "path string, ord int, text string"))


@pytest.mark.parametrize("k", [1, 5, 500])
def test_equal_to_a_search_over_all_chunks(spark, corpus, k):
    rng = random.Random(k)
    asked = [(q, " ".join(rng.choices(["common", "w1", "w2", "w3", "w7", "w50", "w299", "none"], k=rng.randint(1, 4)))) for q in range(60)] + [(100, ""), (101, "zqxjkv"), (102, "common common")]
    queries = spark.createDataFrame(asked, "qid long, query string")
    own = checkpoint(postings.postings(corpus))
    got = postings.search(queries, own, postings.weights(own), k)
    want = retrieval.lexical_search(queries, corpus, k)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_classes_are_skipped(spark, corpus):
    own = postings.weights(postings.postings(corpus))
    queries = spark.createDataFrame([(1, "common w1"), (2, "common")], "qid long, query string")
    both, alone = (postings.skipped(q, own, 2).first() for q in (queries, queries.where("qid = 2")))
    assert 0.8 * alone.postings < alone.skipped < alone.postings
    assert alone.skipped <= both.skipped < both.postings
    assert tuple(postings.skipped(queries.limit(0), own).first()) == (0, 0)


def test_weights_and_df_agree(spark, corpus):
    own = postings.postings(corpus)
    assert sorted(map(tuple, postings.freq_of(postings.weights(own)).collect())) == sorted(map(tuple, retrieval.doc_freq(corpus).collect()))


def empty(spark):
    return {k: spark.createDataFrame([], v) for k, v in schema.INDEX.items()}


def built(spark, texts):
    notes = spark.createDataFrame([(p, t, DAY, len(t)) for p, t in texts.items()], "path string, text string, mtime timestamp, size long")
    none = {k: v for k, v in empty(spark).items() if k in ("notes", "chunks", "emb", "df")}
    return index.build_index(notes, none, chunking.chunk_notes_index, V.hashing_embedder, F.lit(NOW), checkpoint)


ROWS = {"notes": ("path", "hash", "n_chunks"), "chunks": ("path", "ord", "text", "vec"), "df": ("term", "n"), "postings": ("term", "cls", "path", "ord", "tf", "len"), "weights": ("term", "cls", "n")}


def same(got, want):
    for table, names in ROWS.items():
        assert sorted(map(tuple, got[table].select(*names).collect())) == sorted(map(tuple, want[table].select(*names).collect())), table


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_and_order_of_a_log_gives_one_index(spark, tmp_path, seed):
    """Late writes, late and repeated deletions, paths used again: batches of any size in any order."""
    rng = random.Random(seed)
    log, text = [], {}
    for seq in range(40):
        path = f"n{rng.randrange(6)}.md"
        gone = rng.random() < 0.3
        words = None if gone else "# A\n" + " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(8, 20))) + f" {seq}"
        log.append((seq, path, words, DAY, gone))
        text[path] = words
    events = log + rng.sample(log, 8) + [(None, "n1.md", "no number", DAY, False), (99, None, "no path", DAY, False)]
    rng.shuffle(events)
    cuts = sorted(rng.sample(range(1, len(events)), 4))
    write_index(empty(spark), str(tmp_path / "-1"))
    for batch, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(events)], strict=True)):
        previous = current_index(spark, str(tmp_path), batch - 1)
        part = spark.createDataFrame(events[a:b], EVENTS)
        write_index(changes(part, previous, chunking.chunk_notes_index, V.hashing_embedder, F.lit(NOW), checkpoint), str(tmp_path / str(batch)))
    got = current_index(spark, str(tmp_path), len(cuts))
    same(got, built(spark, {p: t for p, t in text.items() if t is not None}))
    last = {path: (seq, gone) for seq, path, _, _, gone in log}
    assert {r.path: (r.seq, r.deleted) for r in got["seen"].collect()} == last


def test_an_event_that_comes_late(spark, tmp_path):
    """Seq 5 after seq 10 in a later batch; a write older than the deletion of its path."""
    write_index({k: v for k, v in empty(spark).items() if k not in ("seen", "postings", "weights")}, str(tmp_path / "-1"))
    batches = [[(10, "a.md", "the text of ten, with some words", DAY, False), (8, "b.md", None, DAY, True)], [(5, "a.md", "the text of five, with some words", DAY, False), (7, "b.md", "a note that is gone, long ago", DAY, False)]]
    for batch, events in enumerate(batches):
        previous = current_index(spark, str(tmp_path), batch - 1)
        write_index(changes(spark.createDataFrame(events, EVENTS), previous, chunking.chunk_notes_index, V.hashing_embedder, F.lit(NOW), checkpoint), str(tmp_path / str(batch)))
    got = current_index(spark, str(tmp_path), 1)
    assert [tuple(r) for r in got["chunks"].select("path", "text").collect()] == [("a.md", batches[0][0][2])]
    assert "postings" not in got  # the index had none to begin with
    assert "seen" not in read_index(spark, str(tmp_path / "-1")) and got["seen"].count() == 2


def test_watermark(spark, tmp_path):
    from notelake.streaming.index_stream import newer, without_old

    days = lambda n: DAY + dt.timedelta(days=n)
    seen = spark.createDataFrame([("a", 5, False, days(10)), ("b", 3, True, days(1)), ("c", 4, True, days(9)), ("d", 1, False, days(0)), ("e", 2, True, None)], schema.SEEN)
    kept = without_old(seen, "7 days")
    assert sorted(r.path for r in kept.collect()) == ["a", "c", "d", "e"]
    events = spark.createDataFrame([(1, "b", "too late, though forgotten", days(1), False), (9, "b", "new", days(11), False), (3, "c", "older", days(10), False), (2, "x", "no time", None, False), (7, "y", "at the mark", days(3), False)], EVENTS)
    assert sorted((r.path, r.seq) for r in newer(events, kept, "7 days").collect()) == [("b", 9), ("x", 2), ("y", 7)]
    assert sorted((r.path, r.seq) for r in newer(events.where("seq = 1"), kept).collect()) == [("b", 1)]
