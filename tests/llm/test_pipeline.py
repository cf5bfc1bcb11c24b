import sys
from pathlib import Path

from conftest import DATA
from test_packing import check
from test_simhash import slow_near_copies

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

from notelake.llm import mixing, toxicity  # noqa: E402


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["drop_toxic", "near_copies", "mix", "pack"]
    before = docs
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, DATA).write.parquet(str(tmp_path / name))
        outs.append(before := spark.read.parquet(str(tmp_path / name)))
    clean, single, mixed, packed = outs
    assert clean.columns == single.columns == mixed.columns == docs.columns

    verdict = toxicity.toxicity(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in verdict if not r.toxic}

    # All pairs of documents by their sets of five-word shingles, linked from 0.8 on.
    assert {r.doc_id for r in single.collect()} == slow_near_copies([(r.doc_id, r.text) for r in clean.collect()])

    times = {r.doc_id: r.times for r in mixing.mixed(single).collect()}
    taken: dict[int, int] = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert taken == {d: n for d, n in times.items() if n}

    assert packed.count() == corpus_pipeline.run(spark, DATA).count()
    rows = packed.collect()
    copies: dict[tuple, int] = {}
    once = []
    for r in rows:
        copies[r.doc_id, r.piece] = copies.get((r.doc_id, r.piece), 0) + 1
    assert all(n == taken[d] for (d, _), n in copies.items())
    # Each copy is a document of its own: hand each its own id to the checker.
    seen: dict[tuple, int] = {}
    for r in rows:
        k = seen[r.doc_id, r.piece] = seen.get((r.doc_id, r.piece), 0) + 1
        once.append(type("Piece", (), r.asDict() | {"doc_id": (r.doc_id, k)}))
    texts = {(r.doc_id, k + 1): r.text for r in single.collect() for k in range(taken.get(r.doc_id, 0))}
    sequences, total = check(once, texts)
    assert sequences <= -(-total // 2048) * 1.02 + 1


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names; then no rows."""
    long = "word " * 50_000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (None, "some text without an id", None, "a", 5), (None, None, None, None, None), (3, long, "en", "b", len(long)),
        (4, "one two three four five six", "en", "a", 1), (4, "one two three four five six", "en", "a", 1), (4, "quite another text under the same id", "en", "a", 1), (5, "\n\t ", "en", None, 3),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ["component_id", "fp", "size", "target", "rank", "key", "sequence_id", "offset", "k", "d", "toxic", "label", "ids", "piece"]
    docs = spark.createDataFrame([(*r, *range(len(extra))) for r in rows], names + "".join(f", {c} int" for c in extra))
    for k, some in enumerate((docs, docs.limit(0))):
        before = some
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, before, DATA).write.parquet(str(tmp_path / f"{k}-{name}"))
            after = spark.read.parquet(str(tmp_path / f"{k}-{name}"))
            if name != "pack":
                assert after.columns == docs.columns
            if k:
                assert after.count() == 0
            elif name == "drop_toxic":
                assert after.count() == len(rows)
            elif name == "near_copies":
                # 1, 2 and 5 have no words; one of the equal rows stays; rows without an id stay.
                assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in after.collect()) == sorted([("1", ""), ("None", "some "), ("None", ""), ("3", "word "), ("4", "one t"), ("4", "quite")])
            before = after
