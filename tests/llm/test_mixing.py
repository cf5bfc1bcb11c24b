import pytest
from conftest import DATA

from notelake.llm import mixing


def fill(sizes, weights=(1, 2, 3)):
    """Targets, by sharing again and again what is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        rest = sum(sizes) - sum(3 * sizes[i] for i in full)
        open_ = sum(w[i] for i in range(len(sizes)) if i not in full)
        t = [3 * n if i in full else rest * w[i] / open_ for i, n in enumerate(sizes)]
        over = {i for i, n in enumerate(sizes) if i not in full and t[i] > 3 * n}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize("sizes", [[100], [1, 1000, 10], [5, 5, 5, 5000], [0, 3, 9], [0, 0], [7, 1, 1, 1, 1, 900]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.sources_to_targets(df).orderBy("source").collect()]
    assert got == pytest.approx(fill(sizes))


def test_documents(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mixed(df).collect()
    assert sorted(rows) == sorted(mixing.mixed(df.repartition(7)).collect())
    source = {r.doc_id: r.source for r in df.collect()}
    taken, target, largest = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s], largest[s] = r.target, max(largest.get(s, 0), r.size)
        assert r.taken == r.size * r.times and 0 <= r.times <= 3
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in taken)
    times = {r.doc_id: r.times for r in rows}
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    got: dict[int, int] = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: n for d, n in times.items() if n}


def test_quality_weighs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, "word " * 10, "a" if i % 2 else "b", i % 4 < 2) for i in range(4000)], "doc_id long, text string, source string, good boolean")
    rows = mixing.mixed(df, weights=(1, 3), quality=lambda t: F.when(F.col("good"), 1.0).otherwise(0.2)).collect()
    a = [r for r in rows if r.target < 20_000]
    good = sum(r.times for r in a if r.doc_id % 4 < 2)
    assert good > 2 * sum(r.times for r in a if r.doc_id % 4 >= 2)


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", None), (None, "some words", None), (3, "some more words", "a"), (3, "some more words", "a"), (4, "w " * 100_000, "b")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mixed(df).collect()
    assert len(got) == 6 and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mixed(df.limit(0)).count() == 0
    assert mixing.mix_documents(df.limit(0)).columns == df.columns
    assert mixing.mix_documents(df).count() == sum(r.times for r in got)


def near_targets(spark, rows):
    """Each source's taken words are within one document of its target, and copies stand as often as they are taken."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed(df).withColumnRenamed("doc_id", "d").collect()
    assert len(got) == len(rows)
    again = sorted(map(tuple, mixing.mixed(df.repartition(3)).collect()), key=str)
    assert again == sorted(map(tuple, got), key=str)
    by_target, largest = {}, max(r.size for r in got)
    for r in got:
        t = by_target.setdefault((r.target, r.source_size), [0])
        t[0] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken - target) <= largest for (target, _), (taken,) in by_target.items())
    assert mixing.mix_documents(df).count() == sum(r.times for r in got)
    return by_target


def test_equal_rows_without_ids(spark):
    text = "one two three four five six seven eight nine ten"
    targets = near_targets(spark, [(None, text, "a")] * 1000 + [(i, text, "b") for i in range(1000)])
    assert sorted(round(t) for t, _ in targets) == [6667, 13333]


def test_repeated_rows(spark):
    near_targets(spark, [(7, "the same row again", "a")] * 700 + [(i, f"text {i}", "a") for i in range(50)] + [(i, "other words", "b") for i in range(400)])


def test_texts_without_ids_draw_apart(spark):
    near_targets(spark, [(None, f"text number {i}", "a" if i % 2 else None) for i in range(600)])


def test_many_sources(spark):
    sizes = [(i * 7919) % 1000 + 1 for i in range(500)]
    df = spark.createDataFrame([(f"s{i:04d}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r.target for r in mixing.sources_to_targets(df.repartition(5)).orderBy("source").collect()]
    assert got == pytest.approx(fill(sizes))
