import base64
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from notelake import schema
from notelake.functions import chunking
from notelake.functions import text as T
from notelake.functions import vectors as V
from notelake.jobs import queries
from notelake.jobs.queries import checkpoint
from notelake.operators import graph, index, notes, retrieval, scan, similarity, snapshots
from notelake.sources.notes import live_docs, read_notes_dir, read_raw_docs, write_manifest, write_snapshot
from notelake.streaming.index_stream import EVENTS, current_index, refresh, stream_index

NOW = dt.datetime(2024, 1, 13, tzinfo=dt.UTC)


def vault(spark, **texts):
    return spark.createDataFrame([(p.replace("__", "/") + ".md", t) for p, t in texts.items()], "path string, text string")


def value(spark, column, **row):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in row.items()]).select(column.alias("v")).first().v


def test_text(spark):
    assert value(spark, T.tokenize(F.col("x")), x="Réunión de Docker: açai") == ["réunión", "de", "docker", "a", "ai"]
    assert value(spark, T.key_terms(F.col("x")), x="no si de") == ["no", "si", "de"]
    assert value(spark, T.key_terms(F.col("x")), x="backup de la red") == ["backup", "red"]
    assert value(spark, T.clean_note_text(F.col("x")), x="[Open in Obsidian](obsidian://x)\n\n---\n\nbody\n") == "body\n"
    assert value(spark, T.strip(F.col("x")), x="  a b ") == "a b"
    assert value(spark, T.base_name(F.col("x")), x="a/b/Foo.Bar.md") == "foo.bar"
    assert value(spark, T.tags(F.col("x")), x="---\ntags: [a, 'b']\n---\n#c x#no\n```\n#d\n```\n#e") == ["a", "b", "c", "e"]
    assert value(spark, T.tags(F.col("x")), x="---\ntags:\n- a\n- b c\n---\n") == ["a", "b c"]


def test_front_matter(spark):
    front = lambda x: value(spark, T.front_matter(F.col("x")), x=x)
    assert front("---\ntitle: A: b\nempty:\ntags:\n- a\n  - b\n# no: key\ntitle: again\nurl:x\n---\nbody: no") == {"title": "A: b", "empty": "", "tags": "- a\n  - b"}
    assert front("text\n---\na: b\n---\n") == front("") == front("---\na: b") == {}
    v = vault(spark, a="---\nk: v\n---\n[[b]]", b=None).withColumn("mtime", F.lit(NOW))
    meta = {r.path: r for r in notes.note_metadata(v, graph.resolve_links(v)).collect()}
    assert meta["a.md"].front == {"k": "v"} and meta["b.md"].front == {} and meta["b.md"].backlinks == 1


def test_blocked_base64(spark):
    blocks = "".join(base64.b64encode(b).decode() for b in (b"abcd", b"hello!!", b"zz"))
    assert bytes(value(spark, T.decode_payload(F.lit("x.PDF"), F.col("c")), c=blocks[:5] + "\n" + blocks[5:])) == b"abcdhello!!zz"
    assert bytes(value(spark, T.decode_payload(F.lit("x.md"), F.col("c")), c="ñ=")) == "ñ=".encode()


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    long = "ñandú " * 5000
    (tmp_path / "in" / "a.md").write_text(long)
    (tmp_path / "in" / "sub" / "b c.txt").write_text("x")
    got = {r.path: (r.text, r.size) for r in read_notes_dir(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.md": (long, len(long.encode())), "sub/b c.txt": ("x", 1)}
    (tmp_path / "raw.json").write_text('{"_id":"a","path":"a"}\n{"_id":"h:1","path":"b"}\n{"_id":"_d","path":"c"}\n{"_id":"e","path":"e","deleted":true}\n{"_id":"f","path":""}\n')
    assert [tuple(r) for r in live_docs(read_raw_docs(spark, str(tmp_path / "raw.json"))).collect()] == [("a", 0, 0)]
    df = spark.createDataFrame([("a", "x")], "path string, content string")
    for s in ("s1", "s2", "s1"):
        write_snapshot(df, str(tmp_path / "out"), s)
    assert sorted(r.snapshot for r in spark.read.parquet(str(tmp_path / "out" / "notes")).collect()) == ["s1", "s2"]
    write_manifest(df, str(tmp_path / "out"), "s1")
    assert spark.read.json(str(tmp_path / "out" / "manifests" / "latest")).count() == 1


def test_edits(spark):
    old = spark.createDataFrame([("a", "one two two"), ("b", "x"), ("c", "keep")], "path string, text string")
    ops = spark.createDataFrame(
        [(1, "a", "append", "!", None), (2, "a", "replace", "2", "two"), (3, "a", "prepend", ">", None), (1, "b", "append", "dead", None), (2, "b", "delete", None, None), (1, "d", "write", "new", None), (4, "a", "replace", "z", "absent")],
        "seq long, path string, op string, content string, old_text string",
    )
    assert dict(map(tuple, notes.apply_edits(old, ops).collect())) == {"a": ">one 2 two!", "c": "keep", "d": "new"}
    moves = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "n")], "path string, to_path string")
    assert sorted(r.path for r in notes.move_notes(old, moves).collect()) == ["a", "b", "n"]


def test_links(spark):
    v = vault(spark, x__a="[[b|B]] [[c#h]] [[C.md]] [[a]]", y__a="", b="[[a]] [[nowhere]] [[name: '*/main']] [[url: 'https://x']] [[:space:]] [[12]] [[x/a]]", c="", cmd="[[cmd]]", d="[[cmd]]")
    edges = {tuple(r) for r in graph.resolve_links(v).collect()}
    assert edges == {("x/a.md", "b.md"), ("x/a.md", "c.md"), ("b.md", "x/a.md"), ("d.md", "cmd.md")}
    assert [tuple(r) for r in graph.broken_links(v).collect()] == [("b.md", "nowhere")]
    # Literally, any of ".", "m" and "d" are taken off the end: cmd is then c, which is there.
    assert {("d.md", "c.md"), ("cmd.md", "c.md")} <= {tuple(r) for r in graph.resolve_links(v, compat=True).collect()}
    assert {tuple(r) for r in graph.ambiguous_links(v).collect()} == {("b.md", "a", 2), ("x/a.md", "a", 2)}
    degree = graph.degrees(v, graph.resolve_links(v))
    assert {r.path for r in graph.islands(degree).collect()} == {"y/a.md"}
    parts = {r.path: r.component for r in graph.connected_components(v, graph.resolve_links(v)).collect()}
    assert parts == {"x/a.md": "b.md", "b.md": "b.md", "c.md": "b.md", "y/a.md": "y/a.md", "cmd.md": "cmd.md", "d.md": "cmd.md"}


def test_graph_without_edges(spark):
    v = vault(spark, a="", b="")
    edges = graph.resolve_links(v)
    parts = graph.connected_components(v, edges)
    stats = graph.graph_stats(graph.degrees(v, edges), edges, graph.broken_links(v), parts)
    assert stats.first().components == 2 and not graph.graph_health(stats).first().healthy
    assert {r.metric: (r.before, r.after) for r in graph.compare_graphs(stats, stats).collect()}["islands"] == (2, 2)


def test_long_chain_is_one_component(spark):
    n = 64
    edges = spark.range(n - 1).select(F.format_string("n%03d", F.col("id")).alias("src"), F.format_string("n%03d", F.col("id") + 1).alias("dst"))
    v = spark.range(n).select(F.format_string("n%03d", "id").alias("path"))
    assert {r.component for r in graph.connected_components(v, edges.orderBy(F.rand(1))).collect()} == {"n000"}


def test_proposals(spark):
    pairs = spark.createDataFrame([("long-name.md", "x.md", 0.9), ("a.md", "b.md", 0.85), ("a.md", "c.md", 0.8)], "a string, b string, score double")
    links = spark.createDataFrame([("b.md", "a.md")], "src string, dst string")
    got = {tuple(r)[:2] for r in similarity.propose_links(pairs, links).collect()}
    assert got == {("x.md", "long-name.md"), ("a.md", "c.md"), ("a.md", "b.md")}  # a does not link to b yet
    assert {tuple(r)[:2] for r in similarity.near_duplicates(pairs, links).collect()} == {("long-name.md", "x.md"), ("a.md", "c.md")}
    v = vault(spark, x="hello", a="has\n## Notas relacionadas\n", c="")
    out = {r.path: r.text for r in similarity.apply_links(v, similarity.propose_links(pairs, links)).collect()}
    assert out == {"x.md": "hello\n\n## Notas relacionadas\n\n- [[long-name]]\n"}
    again = similarity.apply_links(spark.createDataFrame(list(out.items()), "path string, text string"), similarity.propose_links(pairs, links))
    assert again.count() == 0


def test_canonical(spark):
    degree = spark.createDataFrame([("keycloak-tutorial.md", 0, 0), ("keycloak-openldap-mendoza.md", 0, 0)], "path string, n_out long, n_in long")
    pairs = spark.createDataFrame([("keycloak-openldap-mendoza.md", "keycloak-tutorial.md", 0.9)], "a string, b string, score double")
    assert similarity.pick_canonical(pairs, degree).first().canonical == "keycloak-tutorial.md"
    v = vault(spark, **{"03-Personal__Secrets__x": "", "06-Todo__y": "", "00-INDEX": "", "z": ""})
    assert [r.path for r in similarity.eligible_notes(v).collect()] == ["z.md"]


@pytest.mark.parametrize("expected,content,status", [(100, "x" * 95, "ok"), (100, "x" * 80, "short"), (100, "x" * 133, "inflated"), (100, "Note not found: a", "unreadable"), (100, "", "unreadable"), (0, "", "ok"), (100, None, "unreadable")])
def test_payloads(spark, expected, content, status):
    live = spark.createDataFrame([("a.md", expected)], "path string, size long")
    assert snapshots.verify_payloads(live, spark.createDataFrame([("a.md", content)], "path string, content string")).first().status == status


def test_secrets(spark):
    quoted = 'token = "' + "s3cr3tvalue" + '"'
    lines = ["/home/" + "someone/x", "-----BEGIN RSA PRIVATE " + "KEY", "AKIA" + "A" * 16, "GK" + "0" * 26, "ghp_" + "a" * 30, "sk-" + "b" * 20, "xoxb-" + "c" * 10, "eyJ" + "d" * 8 + "." + "e" * 8 + ".", quoted, "/home/" + "me/ " + quoted, "clean"]
    files = spark.createDataFrame([("a.txt", "\n".join(lines)), ("skip.md", lines[0]), ("bin", "\0" + lines[0])], "path string, text string")
    found = {r.line: r for r in scan.scan(files, scan.load_rules(scan.GENERIC_RULES)).collect()}
    assert set(found) == set(range(1, 11))
    assert len({c for r in found.values() for c in r.categories}) == 9
    assert found[10].categories == ["credencial-en-claro", "ruta-home"] and found[10].shown == "<oculto> <oculto>"
    rules = scan.load_rules("# c\n\na:x\na:x\n!a:^a.txt:-----")
    assert rules == [("a", "x", False), ("a", "^a.txt:-----", True)]
    assert {r.line for r in scan.scan(files, scan.load_rules("k:PRIVATE|AKIA\n!k:^a.txt:-----")).collect()} == {3}


def _index(spark):
    kinds = {"notes": schema.INDEX_NOTES, "chunks": schema.CHUNKS, "df": schema.DOC_FREQ, "emb": schema.EMBEDDINGS}
    return {k: spark.createDataFrame([], v) for k, v in kinds.items()}


def _notes(spark, texts):
    return spark.createDataFrame([(p, t, dt.datetime(2024, 1, 1), len(t)) for p, t in texts.items()], "path string, text string, mtime timestamp, size long")


def _build(spark, texts, previous):
    out = index.build_index(_notes(spark, texts), previous, chunking.chunk_notes_index, V.hashing_embedder, F.lit(NOW), checkpoint)
    return {k: checkpoint(v) for k, v in out.items()}


def _rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_incremental_is_full(spark):
    a = {"a.md": "# A\n" + "alpha beta " * 20, "b.md": "# B\n" + "gamma " * 30, "c.md": "delta " * 30}
    b = {"a.md": a["a.md"].replace("alpha", "alphx"), "b.md": "Note not found: b", "d.md": "new words " * 20}
    first = _build(spark, a, _index(spark))
    second = _build(spark, b, first)
    full = _build(spark, {"a.md": b["a.md"], "b.md": a["b.md"], "d.md": b["d.md"]}, _index(spark))
    for table, names in (("chunks", ("path", "ord", "text", "vec")), ("df", ("term", "n")), ("notes", ("path", "hash", "n_chunks"))):
        assert _rows(second[table], *names) == _rows(full[table], *names)


def test_stream_is_batch(spark, tmp_path):
    from notelake.sources.notes import write_index

    events = [(1, "a.md", "one two three four five six seven", dt.datetime(2024, 1, 1), False), (2, "b.md", "gone soon, this note of words", dt.datetime(2024, 1, 1), False), (3, "b.md", None, None, True), (4, "a.md", "one two three four five six eight", dt.datetime(2024, 1, 2), False)]
    write_index(_index(spark), str(tmp_path / "index" / "-1"))
    spark.createDataFrame(events, EVENTS).coalesce(1).write.parquet(str(tmp_path / "events"))
    q = stream_index(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "events")), str(tmp_path / "index"), write_index, chunking.chunk_notes_index, V.hashing_embedder, F.lit(NOW), checkpoint, str(tmp_path / "cp"))
    q.awaitTermination()
    want = refresh(spark.createDataFrame(events, EVENTS), _index(spark), chunking.chunk_notes_index, V.hashing_embedder, F.lit(NOW), checkpoint)
    got = spark.read.schema(schema.CHUNKS).parquet(str(tmp_path / "index" / "0" / "chunks"))
    assert _rows(got, "path", "ord", "text") == _rows(want["chunks"], "path", "ord", "text") == [("a.md", 0, events[3][2])]


def test_stream_writes_changes_only(spark, tmp_path):
    from notelake.sources.notes import write_index

    start = {"a.md": "alpha beta gamma delta words", "b.md": "gamma delta words of some length", "c.md": "this one stays as it is, always"}
    day = dt.datetime(2024, 1, 2)
    batches = [
        [(1, "a.md", "alpha beta gamma epsilon words", day, False)],
        [(2, "a.md", None, None, True), (3, "d.md", "delta is a new note of words", day, False)],
        [(4, "a.md", start["a.md"], day, False), (5, "d.md", "Note not found: d", day, False)],
        [(6, "b.md", start["b.md"], day, False), (7, "x.md", None, None, True), (8, "d.md", "delta is another note now", day, False)],
        [(9, "b.md", None, None, True)],
    ]
    write_index(_build(spark, start, _index(spark)), str(tmp_path / "index" / "-1"))
    (tmp_path / "events").mkdir()
    folder, events = str(tmp_path / "index"), spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    want = {"a.md": start["a.md"], "c.md": start["c.md"], "d.md": "delta is another note now"}
    for batch in batches:
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        stream_index(events, folder, write_index, chunking.chunk_notes_index, V.hashing_embedder, F.lit(NOW), checkpoint, str(tmp_path / "cp"), fold=2).awaitTermination()
    full, got = _build(spark, want, _index(spark)), current_index(spark, folder, 4, 2)
    for table, names in (("chunks", ("path", "ord", "text", "vec")), ("df", ("term", "n")), ("notes", ("path", "hash", "n_chunks"))):
        assert _rows(got[table], *names) == _rows(full[table], *names)
    assert got["emb"].count() == got["emb"].dropDuplicates(["h"]).count() == 6
    # What is unchanged isn't written again; what is needless is gone.
    assert [r.path for r in spark.read.schema(schema.CHUNKS).parquet(f"{folder}/3/chunks").collect()] == ["d.md"]
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == ["-1", "1-whole", "2", "3", "3-whole", "4"]


def test_search(spark):
    texts = {"docker.md": "# Docker\ncontainers on the host run here with volumes", "other.md": "# Other\nnothing of that kind, only 99315 in words", "third.md": "text about gardens and flowers of all sorts"}
    built = _build(spark, texts, _index(spark))
    queries = spark.createDataFrame([(1, "docker volumes"), (2, "zqxjkv-9931"), (3, "")], "qid long, query string")
    hits = checkpoint(retrieval.index_search(queries, built["chunks"], built["df"], built["chunks"].count(), V.hashing_embedder))
    assert hits.where("qid = 1 and rank = 1").first().path == "docker.md"
    kept = {r.qid for r in retrieval.relevance_floor(hits, queries).collect()}
    assert kept == {1}
    best = retrieval.lexical_search(queries, built["chunks"])
    assert [r.path for r in best.where("qid = 1 and rank = 1").collect()] == ["docker.md"]
    v = spark.createDataFrame(list(texts.items()), "path string, text string")
    meta = v.select("path", F.lit(dt.datetime(2024, 1, 12)).alias("mtime"), F.lit(0).alias("backlinks"))
    ranked = retrieval.rag_search(queries, v, meta, chunking.chunk_notes, F.lit(NOW), V.hashing_embedder)
    assert ranked.where("qid = 1 and rank = 1").first().path == "docker.md"


def test_restore_and_retention(spark):
    s = spark.createDataFrame([("20240101-000000", "a", 1), ("20240110-000000", "b", 2), ("20240112-000000", "b", 3)], "snapshot string, path string, size long")
    want = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {(r.path, r["size"]) for r in snapshots.restore(s, want).collect()} == {("a", 1), ("b", 3)}
    assert [r["size"] for r in snapshots.restore(s).collect()] == [3]
    assert {tuple(r) for r in snapshots.retention(s, NOW, keep_manifests=2).collect()} == {("20240101-000000", "notes"), ("20240101-000000", "manifest")}


def test_bodies_and_ranking(spark):
    chunks = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("b", 0, "x")], "path string, ord int, text string")
    assert dict(map(tuple, graph.note_bodies(chunks).collect())) == {"a": "one\ntwo", "b": "x"}
    proposals = spark.createDataFrame([("a", "x", 0.8), ("b", "y", 0.9), ("a", "z", 0.85)], "src string, dst string, score double")
    got = [(r.src, r.dst, r.link_rank) for r in similarity.rank_proposals(proposals).collect()]
    assert got == [("b", "y", 1), ("a", "z", 1), ("a", "x", 2)]
    v = vault(spark, x__a="", x__b="", y="")
    assert [r.path for r in notes.list_notes(v, "x", limit=1).collect()] == ["x/a.md"]
    assert {r.folder for r in notes.list_folders(v).collect()} == {"x"}


def test_note_blocks(spark):
    raw = spark.createDataFrame(
        [("h:1", None, None, None), ("h:2", None, None, False), ("a", "a.md", ["h:1", "h:1", "h:9", None], False), ("b", "b.md", None, None), ("c", "c.md", ["h:2"], True),
         ("a2", "a.md", ["h:2"], False), ("_design/x", "x", ["h:1"], False)],
        "_id string, path string, children array<string>, deleted boolean",
    )
    assert sorted(tuple(r) for r in notes.note_blocks(raw).collect()) == [("a.md", 3, 1), ("b.md", 0, 0)]
    assert notes.note_blocks(raw.limit(0)).count() == 0


def test_restore_check(spark):
    got = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s1", "b"), ("s3", "a")], "snapshot string, path string")
    manifest = spark.createDataFrame([("s1", 2), ("s2", 1)], "snapshot string, exported long")
    rows = {tuple(r) for r in snapshots.restore_check(got, manifest).collect()}
    assert rows == {("s1", 2, 2, True), ("s2", 0, 1, False), ("s3", 1, None, False)}


def test_links_of_the_same_score_as_shown_are_ranked_by_path(spark, monkeypatch):
    proposed = spark.createDataFrame([("a", "y", 0.8000002), ("a", "x", 0.8000001), ("b", "z", 0.79)], "src string, dst string, score double")
    monkeypatch.setattr(queries, "_proposed", lambda spark, d: proposed)
    rows = {(r.src, r.dst, r.link_rank) for r in queries.l6_rank_proposals(spark, "").collect()}
    assert rows == {("a", "x", 1), ("a", "y", 2), ("b", "z", 1)}


@pytest.mark.parametrize(("square", "compat"), [(2048, False), (3, False), (3, True)])
def test_links_by_name_and_their_numbers(spark, monkeypatch, square, compat):
    """Every link to every note of a name, in squares; the numbers of links without the links; paths that come twice, a note that links to itself."""
    monkeypatch.setattr(similarity, "SQUARE", square)
    texts = {f"f{i}/Index.md": "[[index]] [[one]]" if i % 2 else "" for i in range(9)} | {f"l{i}.md": "[[Index]] [[index.md]] [[none]]" for i in range(10)} | {"one.md": "[[one]] [[l1]]", "x/one.md": "", "cmd.md": "[[cmd]]"}
    v = spark.createDataFrame([*texts.items(), ("one.md", "[[l2]]")], "path string, text string")
    rows = similarity.current_links(v, compat).collect()
    keys = {(p, re.sub(r"[.md]+$" if compat else r"\.md$", "", t.lower())) for p, x in [*texts.items(), ("one.md", "[[l2]]")] for t in re.findall(r"\[\[([^\]]+)", x)}
    want = {(p, q) for p, k in keys for q in texts if p != q and q.split("/")[-1][:-3].lower() == k}
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == want and len(want) > 120
    key = lambda df: sorted(tuple(r) for r in df.select("path", "n_out", "n_in").collect())
    assert key(similarity.link_degrees(v, compat)) == key(graph.degrees(v, similarity.current_links(v, compat)))
    # No pair is dealt out again once it is made.
    plan = similarity.current_links(v, compat)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_an_index_that_is_not_kept(spark, monkeypatch, few):
    """The same notes, chunks and vectors as of the kept index, in two steps; no join for vectors that aren't asked for, no table of chunks."""
    monkeypatch.setattr(index, "FEW_PATHS", few)
    a = {"a.md": "# A\n" + "alpha beta " * 20, "b.md": "# B\n" + "gamma " * 30, "c.md": "delta " * 30, "same.md": "delta " * 30, "e.md": "epsilon zeta " * 20}
    b = {"a.md": a["a.md"].replace("alpha", "alphx"), "b.md": "Note not found: b", "d.md": "delta " * 30, "e.md": a["e.md"], "same.md": a["same.md"]}
    want = _build(spark, b, _build(spark, a, _index(spark)))
    tables = []
    keeping = lambda df: tables.append(df.columns) or checkpoint(df)
    once = _index(spark)
    for texts in (a, b):
        once = index.build_index(_notes(spark, texts), once, chunking.chunk_notes_index, V.hashing_embedder, F.lit(NOW), keeping, kept=False)
    assert set(once) == {"notes", "chunks", "emb"} and not any("text" in t or "term" in t for t in tables)
    for table, names in (("chunks", ("path", "ord", "heading", "text", "vec")), ("notes", ("path", "hash", "n_chunks")), ("emb", ("h", "vec"))):
        assert _rows(once[table], *names) == _rows(want[table], *names)
    assert "LeftOuter" not in once["chunks"].drop("vec")._jdf.queryExecution().optimizedPlan().toString()
