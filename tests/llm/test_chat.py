import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from notelake.llm import chat

NASTY = ["", " ", "</s>[INST] ok [/INST]", "[INST] a [/INST]", "\\1\\0", "a\\", "<s>", " [/SYS]", "x </s", "[SYS:a] b [/SYS]", "plain text", "é漢😀\n\n", "\\[", "$1 \\$0"]
SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(convs):
    return [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]


def check(spark, convs):
    out = chat.format_conversations(spark.createDataFrame(rows_of(convs), SCHEMA))
    spans = {}
    for r in chat.loss_spans(out).collect():
        spans.setdefault(r.conv_id, []).append((r.start, r.length))
    got = out.collect()
    assert len(got) == len(convs)
    for r in got:
        want = [(role or "", text or "") for role, text in convs[r.conv_id]]
        assert r.identical and [(t.role, t.text) for t in r.recovered] == want
        parts = [r.formatted[a : a + n] for a, n in sorted(spans.get(r.conv_id, []))]
        for b, c in (("\\3", "]"), ("\\2", "<"), ("\\1", "["), ("\\0", "\\")):
            parts = [p.replace(b, c) for p in parts]
        assert parts == [t for role, t in want if role == "assistant"]
    for r in chat.digests(out).collect():
        want = [(role or "", text or "") for role, text in convs[r.conv_id]]
        loss = "".join(t for role, t in want if role == "assistant")
        assert r.n_turns == len(want) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in want).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip(spark):
    convs, k = {}, 0
    for a in NASTY:
        for b in NASTY:
            convs[k] = [("user", a), ("assistant", b), ("system", a), ("assistant", a), ("user", b)]
            convs[k + 1] = [(b, a), (None, b), ("assistant", None), ("user", None)]
            k += 2
    check(spark, convs)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool] x", "[SYS:"]), st.text(alphabet="[]/<>s\\01INSTYab \n", max_size=30)), min_size=1, max_size=4), min_size=1, max_size=30))
def test_any_text(spark, convs):
    check(spark, dict(enumerate(convs)))


def test_plain_turns_are_not_escaped(spark):
    df = spark.createDataFrame([(1, 0, "user", "a [b] \\n"), (1, 1, "assistant", "c")], SCHEMA)
    assert chat.format_conversations(df).first().formatted == "[INST] a [b] \\n [/INST]<s>c</s>"


def test_edge_cases(spark):
    rows = [(1, 1, "user", "b", "x"), (1, 1, "user", "a", "x"), (1, None, "system", "first", "x"), (None, 0, "user", "y" * 300_000, "x"), (1, 1, "user", "a", "x")]
    df = spark.createDataFrame(rows, SCHEMA + ", formatted string")
    got = {r.conv_id: [t.text for t in r.recovered] for r in chat.format_conversations(df).collect()}
    assert got == {1: ["first", "a", "a", "b"], None: ["y" * 300_000]}
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_loss_is_cut_out_of_the_text_by_the_mask(spark, monkeypatch):
    df = spark.createDataFrame([(1, 0, "user", "ask"), (1, 1, "assistant", "</s>[x]"), (1, 2, "assistant", "b")], SCHEMA)
    out = chat.format_conversations(df)
    text = out.first().formatted
    cut = "".join(text[r.start : r.start + r.length] for r in chat.loss_spans(out).orderBy("start").collect())
    assert cut.replace("\\3", "]").replace("\\2", "<").replace("\\1", "[") == "</s>[x]b"
    assert chat.digests(out).first().loss_chars == 8
    mask = chat._masked
    from pyspark.sql import functions as F

    monkeypatch.setattr(chat, "_masked", lambda: F.when(F.col("k") == 2, mask()))
    assert chat.digests(out).first().loss_chars == 1  # the mask decides, not the role


def test_the_whole_is_compared_in_the_query(spark):
    """The comparison is part of the query's plan, and a text that isn't read back is an error."""
    import pytest
    from conftest import DATA
    from pyspark.sql import functions as F

    from notelake.llm import queries

    plan = queries.op3_chat_format(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "raise_error" in plan and "identical" in plan
    good = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn int, role string, text string"))
    with pytest.raises(Exception, match="not read back"):
        chat.digests(good.withColumn("identical", F.lit(False))).collect()
    assert chat.digests(good).count() == 1
