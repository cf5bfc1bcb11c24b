"""The graph kept current against the graph made from all notes."""

import random

import pytest

from notelake.operators import graph, graph_state


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def same(spark, state, notes):
    n = spark.createDataFrame(sorted(notes.items()), "path string, text string")
    edges = graph.resolve_links(n)
    assert rows(graph_state.edges(state), "src", "dst") == rows(edges, "src", "dst")
    assert rows(graph_state.broken(state), "path", "target") == rows(graph.broken_links(n), "path", "target")
    assert rows(state["degrees"], "path", "n_out", "n_in") == rows(graph.degrees(n, edges), "path", "n_out", "n_in")
    assert rows(state["components"], "path", "component") == rows(graph.connected_components(n, edges), "path", "component")
    return n, edges


def kept(state):
    return {k: v.sparkSession.createDataFrame(v.collect(), v.schema) for k, v in state.items()}


def change(spark, state, batch):
    return kept(graph_state.update_graph(state, spark.createDataFrame(batch, "path string, text string, seq long")))


def replay(notes, batch):
    last = {}
    for path, text, seq in batch:
        if path is not None:
            last[path] = max(last.get(path, (-1, "")), (seq, text or ""), key=lambda x: x[0])
            if last[path][0] == seq:
                last[path] = (seq, text)
    for path, (_, text) in last.items():
        if text is None:
            notes.pop(path, None)
        else:
            notes[path] = text
    return notes


@pytest.mark.parametrize("seed", [1])
def test_random_changes(spark, seed):
    rng = random.Random(seed)
    names = [f"{f}n{i}.md" for i in range(14) for f in ("", "b/")]
    link = lambda: rng.choice([f"[[n{rng.randrange(18)}]]", f"[[b/n{rng.randrange(18)}.md|x]]", "[[12]]"])
    state, notes, seq = graph_state.empty(spark), {}, 0
    for size in (24, 8):
        batch = []
        for _ in range(size):
            seq += 1
            text = None if rng.random() < 0.35 and notes else " ".join(link() for _ in range(rng.randrange(3)))
            batch.append((rng.choice(names), text, seq))
        state, notes = change(spark, state, [*batch, (None, "[[n1]]", 0)]), replay(notes, batch)
        same(spark, state, notes)


def test_names_that_come_and_go(spark):
    notes = {"a.md": "[[b]] [[b]] [[x]]", "m/b.md": "[[c|see]]", "c.md": "", "d.md": "[[m/b]] [[d]]", "z.md": ""}
    state = change(spark, graph_state.empty(spark), [(p, t, 0) for p, t in notes.items()])
    n, edges = same(spark, state, notes)
    want = graph.graph_stats(graph.degrees(n, edges), edges, graph.broken_links(n), graph.connected_components(n, edges)).collect()
    assert graph_state.stats(state).select(*want[0].asDict()).collect() == want
    for batch in (
        [("b.md", "", 1)],  # takes the links to b, not the one to m/b
        [("m/b.md", None, 2), ("x.md", "[[z]]", 2)],
        [("b.md", None, 3), ("x.md", None, 3), ("gone.md", None, 3)],
        [("a.md", "[[c]]", 5), ("a.md", None, 4)],  # the last counts
        [("a.md", "[[c]] [[z]] [[b]]", 6)],
        [("a.md", "[[c]] [[b]]", 7)],  # loses one edge and keeps two
    ):
        state, notes = change(spark, state, batch), replay(notes, batch)
        same(spark, state, notes)
    assert {r.path for r in state["names"].collect()} == set(notes)


def test_cost_follows_what_is_touched(spark):
    chains = {f"g{g}/n{g}-{i}.md": f"[[n{g}-{i + 1}]]" for g in range(30) for i in range(5)}
    state = change(spark, graph_state.empty(spark), [(p, t, 0) for p, t in chains.items()])
    batch = [("g3/n3-2.md", None, 1), ("g7/n7-4.md", "[[n9-0]]", 1)]
    new = graph_state.graph_changes(state, spark.createDataFrame(batch, "path string, text string, seq long"))
    # One link to a vanished note and one that was written; the notes of chain 3, and one of the chains 7 and 9 that joins the other.
    report = {r.table: r["rows"] for r in graph_state.change_report(new).collect()}
    assert report["links"] == 2 and report["names"] == 2 and report["degrees"] <= 4 and report["components"] == 4 + 5
    same(spark, change(spark, state, batch), replay(chains, batch))
