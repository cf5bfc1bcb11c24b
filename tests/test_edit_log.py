"""The edit log with moves against a plain replay."""

import hashlib
import random

import pytest
from conftest import DATA

from notelake.jobs import queries, views
from notelake.operators import notes

OPS = "seq long, path string, op string, content string, old_text string, to_path string"


def replay(state, log):
    state = dict(state)
    for _, path, op, content, old, to in sorted((r for r in log if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        c, text = content or "", state.get(path)
        if op == "write":
            state[path] = c
        elif op == "delete":
            state.pop(path, None)
        elif op == "append":
            state[path] = (text or "") + c
        elif op == "prepend":
            state[path] = c + (text or "")
        elif op == "replace" and text is not None and old:
            state[path] = text.replace(old, c, 1)
        elif op == "move" and text is not None and to is not None and to not in state:
            state[to] = state.pop(path)
    return state


def got(spark, state, log):
    start = spark.createDataFrame(list(state.items()), "path string, text string")
    rows = notes.apply_log(start, spark.createDataFrame(log, OPS)).collect()
    assert len({r.path for r in rows}) == len(rows)
    return {r.path: r.text for r in rows}


@pytest.mark.parametrize(("seed", "part"), [(1, 1000), (2, 2), (3, 1)])
def test_random_logs(spark, monkeypatch, seed, part):
    monkeypatch.setattr(notes, "PART", part)
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)] + [f"far{i}" for i in range(5)]
    state = {n: f"text of {n}" for n in names[:5]}
    log = []
    for seq in range(400):
        op = rng.choice(["write", "delete", "append", "prepend", "replace", "move", "move", "move"])
        path = rng.choice(names[:9] if op == "move" else names)
        log.append((seq, path, op, f"<{seq}>", rng.choice(["text", "<1", ">", ""]), rng.choice(names[:9]) if op == "move" else None))
    rng.shuffle(log)
    assert got(spark, state, log) == replay(state, log)


def test_edits_before_and_after_moves(spark):
    """Swaps by way of a third path, a path that is used again, refused moves, chains, nulls."""
    log = [
        (1, "a", "append", "1", None, None), (2, "a", "move", None, None, "t"), (3, "b", "move", None, None, "a"), (4, "t", "move", None, None, "b"),
        (5, "a", "append", " was b", None, None), (6, "b", "append", " was a", None, None),
        (7, "c", "move", None, None, "d"), (8, "c", "append", "new c", None, None), (9, "d", "replace", "D", "c", None), (10, "d", "move", None, None, "c"),
        (11, "gone", "move", None, None, "x"), (12, "e", "move", None, None, None), (13, "e", "move", None, None, "e"), (None, "e", "write", "no", None, None), (14, None, "write", "no", None, None),
        (15, "e", "delete", None, None, None), (16, "e", "move", None, None, "y"), (17, "e", "write", "again", None, None), (18, "e", "move", None, None, "y"), (19, "z", "append", "only", None, None),
    ]
    state = {"a": "A", "b": "B", "c": "a c text", "e": "E", "f": "F"}
    want = {"a": "B was b", "b": "A1 was a", "c": "new c", "d": "a D text", "y": "again", "f": "F", "z": "only"}
    assert replay(state, log) == want and got(spark, state, log) == want
    assert got(spark, state, [r for r in log if r[2] != "move"]) == replay(state, [r for r in log if r[2] != "move"])


def test_query(spark):
    start = {r.path: r.text for r in queries._edited_notes(spark, DATA).collect()}
    log = [tuple(r) for r in views.log(spark, DATA).select("seq", "path", "op", "content", "old_text", "to_path").collect()]
    want = {p: hashlib.md5(t.encode()).hexdigest() for p, t in replay(start, log).items()}
    assert {r.path: r.text for r in queries.e_apply_log(spark, DATA).collect()} == want
    assert sum(r[2] == "move" for r in log) > 50


def test_a_path_with_many_ops(spark):
    """Long runs of additions, in parts: the plain replay's text, nulls as empty."""
    rng = random.Random(4)
    log = [(i, "hot" if i % 9 else "new", rng.choice(["append", "append", "prepend"]) if i % 1500 else "replace", None if i % 50 == 0 else f"[{i}]", "[7", None) for i in range(6000)]
    state = {"hot": "start", "still": "s"}
    want = replay(state, log)
    start = spark.createDataFrame(list(state.items()), "path string, text string")
    assert {r.path: r.text for r in notes.apply_edits(start, spark.createDataFrame(log, OPS)).collect()} == want


def test_groups_pass_by_in_batches(spark):
    """No task holds a group's ops at once; several groups in a task, each in several batches, are told apart."""
    rng = random.Random(9)
    names = [[f"g{g}n{i}" for i in range(6)] for g in range(12)]
    state = {n: n for group in names for n in group[:3]}
    log = []
    for seq in range(2000):
        group = rng.choice(names)
        op = rng.choice(["move", "move", "append", "delete"])
        log.append((seq, rng.choice(group), op, f"<{seq}>", None, rng.choice(group) if op == "move" else None))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(spark, state, log) == replay(state, log)
        start, ops = spark.createDataFrame(list(state.items()), "path string, text string"), spark.createDataFrame(log, OPS)
        plan = notes.note_intervals(start, ops)._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
