"""Chat formatting with a grammar round trip, by built-in functions only.

Grammar of a formatted conversation, one production a turn:

    user       [INST] text [/INST]        (one space on either side of the text)
    assistant  <s>text</s>
    any other  [SYS:role] text [/SYS]

Each turn is rendered plainly, parsed again and compared with its source; where
they differ its text (and role) is escaped: ``\\`` ``[`` ``<`` ``]`` become ``\\0`` ``\\1``
``\\2`` ``\\3``, so no control string is left.  The parser cuts after each closing mark,
takes the production by its first mark and undoes the escapes.  No closing mark
can begin in another one, so turns that parse alone parse together; the whole is
parsed and compared all the same, and where it differs all its turns are escaped
and it is parsed and compared again (``identical``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_CODES = (("\\", "\\0"), ("[", "\\1"), ("<", "\\2"), ("]", "\\3"))
_CLOSING = r"(?<=( \[/INST\]|</s>| \[/SYS\]))"


def escape(text: Column) -> Column:
    for a, b in _CODES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(_CODES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def _render(role: Column, text: Column, shown_role: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[SYS:"), shown_role, F.lit("] "), text, F.lit(" [/SYS]")))
    )


def _turn(part: Column) -> Column:
    """(role, text) of one production; nulls where it is none."""
    between = lambda a, b: F.substring(part, F.lit(a + 1), F.length(part) - a - b)
    head = F.instr(part, "] ")
    is_user, is_out = part.startswith("[INST] ") & part.endswith(" [/INST]"), part.startswith("<s>") & part.endswith("</s>")
    is_other = part.startswith("[SYS:") & part.endswith(" [/SYS]") & (head > 0)
    role = F.when(is_user, "user").when(is_out, "assistant").when(is_other, unescape(F.substring(part, F.lit(6), head - 6)))
    text = F.when(is_user, between(7, 8)).when(is_out, between(3, 4)).when(is_other, F.substring(part, head + 2, F.length(part) - head - 1 - 7))
    return F.struct(role.alias("role"), unescape(text).alias("text"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    return F.transform(F.filter(F.split(formatted, _CLOSING), lambda p: p != ""), _turn)


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted, recovered, identical)``, one row a conversation.

    Turns go by number, then role and text where numbers repeat; a turn without
    a number comes first.  A null text and a null role are empty; rows with a
    null conversation id make one conversation.  Columns beside these four are
    left out.  ``recovered`` holds the turns that the parser finds in
    ``formatted``, ``identical`` whether they equal the source.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role, text).alias("t"))
    # Turn by turn, before they are gathered: rows are many, conversations may be long.
    r, x = F.col("t.role"), F.col("t.text")
    plain = _render(r, x, r)
    safe = parse(plain) == F.array(F.struct(r.alias("role"), x.alias("text")))
    part = F.when(F.coalesce(safe, F.lit(False)), plain).otherwise(_render(r, escape(x), escape(r)))
    rows = rows.select("conv_id", F.struct(F.col("t.turn"), F.col("t.role"), F.col("t.text"), part.alias("part")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    joined = lambda part: F.array_join(F.transform("turns", part), "")
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    equal = lambda formatted: F.coalesce(parse(F.col(formatted)) == F.col("source"), F.lit(False))
    whole = whole.select("conv_id", "turns", source.alias("source"), joined(lambda t: t["part"]).alias("first"))
    escaped = joined(lambda t: _render(t["role"], escape(t["text"]), escape(t["role"])))
    whole = whole.withColumn("formatted", F.when(equal("first"), F.col("first")).otherwise(escaped))
    return whole.select("conv_id", "formatted", parse(F.col("formatted")).alias("recovered"), equal("formatted").alias("identical"))


def _productions(formatted: DataFrame, *more: str) -> DataFrame:
    """``(conv_id, k, part, at)`` and ``more`` columns: the formatted text's productions in order and where each begins."""
    parts = F.filter(F.split("formatted", _CLOSING), lambda p: p != "")
    rows = formatted.select("conv_id", *more, F.posexplode(parts).alias("k", "part"))
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("at", F.coalesce(F.sum(F.length("part")).over(before), F.lit(0)))


def _masked() -> Column:
    """Where in the formatted text the production's loss lies, (start, length) from 0; null where it has none."""
    mask = F.struct((F.col("at") + 3).alias("start"), (F.length("part") - 7).cast("long").alias("length"))
    return F.when(F.col("part").startswith("<s>") & F.col("part").endswith("</s>"), mask)


def loss_spans(formatted: DataFrame) -> DataFrame:
    """``(conv_id, start, length)`` in characters of ``formatted``: the assistants' texts, as they stand there.

    A conversation without an assistant's turn, or with a null text, has none.
    """
    spans = _productions(formatted).select("conv_id", _masked().alias("m")).where("m is not null")
    return spans.select("conv_id", "m.*")


def digests(formatted: DataFrame) -> DataFrame:
    """What the contract asks of each conversation, all read back from the formatted text.

    Turns come from the parser; the loss is what lies under ``loss_spans`` in
    ``formatted``, cut out and then unescaped.  A conversation that isn't
    identical to its source is an error, never a row.
    """
    rows = _productions(formatted.withColumn("chars", F.length("formatted")), "chars", "identical").withColumn("mask", _masked())
    cut = F.substring("part", (F.col("mask.start") - F.col("at") + 1).cast("int"), F.col("mask.length").cast("int"))
    turn, loss = _turn(F.col("part")), F.when(F.col("mask").isNotNull(), unescape(cut))
    said = F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n"))
    rows = rows.select("conv_id", "chars", "identical", F.struct("k", said.alias("said"), loss.alias("loss")).alias("t"))
    whole = rows.groupBy("conv_id").agg(
        F.count("*").cast("long").alias("n_turns"), F.first("chars").cast("long").alias("formatted_chars"), F.first("identical").alias("identical"), F.sort_array(F.collect_list("t")).alias("t")
    )
    text = lambda field: F.array_join(F.transform("t", lambda t: t[field]), "")
    whole = whole.select("*", text("said").alias("said"), text("loss").alias("loss"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return whole.select(
        "conv_id", "n_turns", digest("said").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        digest("loss").alias("loss_sha256"), F.when(F.col("identical"), F.col("formatted_chars")).otherwise(F.raise_error(F.lit("a formatted conversation is not read back as its source")).cast("long")).alias("formatted_chars"),
    )
