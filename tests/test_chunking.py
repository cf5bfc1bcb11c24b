import pytest

from plain_chunks import index_chunks, semantic_chunks

from notelake.functions.chunking import chunk_notes, chunk_notes_index

LONG = "words that make up a paragraph of some length, so that nothing is joined to it or taken for a fragment. " * 2


def test_short_note():
    assert semantic_chunks("hola") == [("", 0, "prose", "hola")]
    assert semantic_chunks(None) == [("", 0, "prose", "")]
    assert index_chunks("hola") == [] == index_chunks(None)


def test_heading_stays_only_in_index_chunks():
    text = f"# T\n\n{LONG}"
    assert semantic_chunks(text) == [("T", 1, "prose", LONG.strip())]
    assert [c[3] for c in index_chunks(text)] == ["# T", LONG.strip()]
    assert {c[:2] for c in index_chunks(text)} == {("T", 1)}


def test_fences():
    text = f"{LONG}\n~~~\nx = 1\n# no heading"
    assert [(c[2], c[3]) for c in semantic_chunks(text)] == [("prose", LONG.strip()), ("code", "~~~\nx = 1\n# no heading")]
    assert [c[2] for c in index_chunks(text)] == ["prose", "prose"]
    closed = f"```py\nx\n```\n{LONG}"
    assert [c[2] for c in semantic_chunks(closed)] == ["code", "prose"]


def test_long_code_is_cut_at_line_ends():
    line = "x" * 99
    text = "```\n" + "\n".join([line] * 100) + "\n```"
    parts = semantic_chunks(text)
    assert len(parts) == 4 and all(len(p[3]) >= 2990 for p in parts[:3])
    assert "\n".join(p[3] for p in parts) == text
    assert len(index_chunks(text)) == 4 and {c[2] for c in index_chunks(text)} == {"code"}


def test_small_prose_is_joined_under_the_first_heading():
    text = "# A\n" + "a" * 30 + "\n# B\n" + "b" * 60
    assert semantic_chunks(text) == [("A", 1, "prose", "a" * 30 + "\n\n" + "b" * 60)]


def test_lists_and_tables():
    text = f"{LONG}\n- one\n- two\n\n- three\n| a | b |\n| c | d |\nafter"
    assert [(c[2], c[3]) for c in semantic_chunks(text)][1:] == [("list", "- one\n- two\n\n- three"), ("table", "| a | b |\n| c | d |"), ("prose", "after")]
    assert [c[2] for c in index_chunks(text)] == ["prose", "list", "list", "list", "table", "table"]
    assert index_chunks(text)[-1][3] == "| c | d |\nafter"


def test_short_dense_section():
    text = f"# A\n{LONG}\n\n## Backup\nin /srv/backup, every night at three"
    assert index_chunks(text)[-1][0] == "Backup"
    assert [c[0] for c in index_chunks(text, keep_short=False)] == ["A"]


def test_prose_after_a_list_stays_list():
    assert [c[2] for c in index_chunks("- one item of a list\n\nplain words after it\n# H\nx")] == ["list", "list", "prose"]


@pytest.mark.parametrize("seed", range(5))
def test_nothing_is_lost(seed):
    import random

    random.seed(seed)
    kinds = ["# head", "- item", "| a | b |", "", "plain words", "```", "1. first"]
    text = "\n".join(f"{random.choice(kinds)}" for _ in range(200))
    body = "".join("".join(c[3].split()) for c in semantic_chunks(text))
    fenced, want = False, []
    for line in text.split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        if fenced or not line.startswith("# "):
            want += line.split()
    assert body == "".join(want)


def test_frame(spark):
    df = spark.createDataFrame([("a.md", f"# T\n\n{LONG}"), ("b.md", None)], "path string, text string")
    rows = {(r.path, r.ord): (r.heading, r.text) for r in chunk_notes(df).collect()}
    assert rows == {("a.md", 0): ("T", LONG.strip()), ("b.md", 0): ("", "")}


KINDS = ["# head", "#", "## ", "####### seven", " # indented", "- item", "  * item", "+ item", "12. item", "| a | b |", "|", " | x", "", "", "  ", "\u2003", "plain words", "short", LONG, "```", "  ```py", "~~~", "y" * 1600, "z" * 2999, "ñ" * 81, "a\rb", "\x1cc", "\u0663. x"]


def texts():
    import random

    r = random.Random(3)
    for n in [1, 2, 3, 5, 8, 20, 60, 200]:
        for _ in range(40):
            some = r.sample(KINDS, r.randint(2, len(KINDS)))
            yield "\n".join(r.choice(some) for _ in range(n))
    yield from ["", " \n\n ", "x" * 79, "x" * 80, "```" + "q" * 3500 + "\nx\ny", "```\n" + "x\n" * 4000, "#" * 100, "\n" * 100 + "end" * 30, None]


@pytest.mark.parametrize("size", [80, 0, 500])
def test_frames_equal_the_plain_chunkers(spark, size):
    all_texts = list(texts())
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(all_texts)], "path string, text string").repartition(4)
    names = ["heading", "hlevel", "ctype", "text"]

    def same(frame, plain):
        got = {}
        for r in frame.orderBy("path", "ord").collect():
            got.setdefault(r.path, []).append(tuple(r[c] for c in names))
        for i, t in enumerate(all_texts):
            assert got.get(str(i), []) == plain(t), t

    same(chunk_notes(df, size), lambda t: semantic_chunks(t, size))
    same(chunk_notes_index(df, size), lambda t: index_chunks(t, size))
    same(chunk_notes_index(df, size, keep_short=False), lambda t: index_chunks(t, size, keep_short=False))


def test_awkward_rows(spark):
    df = spark.createDataFrame([("a", LONG, 1), ("a", LONG, 2), (None, LONG, 3)], "path string, text string, ord int")
    assert sorted((r.path or "", r.ord) for r in chunk_notes(df).collect()) == [("", 0), ("a", 0), ("a", 0)]
    assert chunk_notes_index(df.limit(0)).count() == 0
    assert "Python" not in chunk_notes(df)._jdf.queryExecution().executedPlan().toString()


def test_many_lines(spark):
    text = "\n".join(["# h", "words", "", "- item", "| a | b |"] * 20000 + ["```"] + ["code"] * 100000)
    df = spark.createDataFrame([("a", text)], "path string, text string")
    assert chunk_notes_index(df).count() == len(index_chunks(text))
    assert chunk_notes(df).count() == len(semantic_chunks(text))


@pytest.mark.parametrize("name, plain", [("c1_chunk_notes", semantic_chunks), ("c2_chunk_notes_index", index_chunks)])
def test_sql_on_awkward_texts(name, plain):
    import duckdb

    from notelake.jobs import sql

    db = duckdb.connect()
    # One row a text that is its own path; nulls aside, as a note of the view has a text.
    notes = dict(enumerate(t for t in texts() if t is not None))
    db.execute("CREATE TABLE given (doc_id BIGINT, path VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO given VALUES (?, ?, ?)", [(i, str(i), t) for i, t in notes.items()])
    got = {}
    for path, *chunk in db.execute(sql._sql(f"SELECT path, heading, hlevel, ctype, text FROM ({sql._BODIES[name]}) ORDER BY path, ord", vault_notes="SELECT * FROM given")).fetchall():
        got.setdefault(int(path), []).append(tuple(chunk))
    for i, t in notes.items():
        assert got.get(i, []) == plain(t), t
