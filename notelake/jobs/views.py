"""A vault of notes, and what else the jobs read, derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a document as markdown; ``l`` is a line, ``i`` its number from 0.
_LINE = """CASE WHEN i % 11 = 0 THEN '## ' || l WHEN i % 11 IN (4,5) THEN '- ' || l WHEN i % 11 = 7 THEN '| a | ' || l || ' |'
  WHEN i % 11 = 8 THEN '' WHEN i % 11 = 9 THEN '```' || chr(10) || l || chr(10) || '```' ELSE l END"""
_NOTES = """SELECT doc_id,
 CASE WHEN doc_id % 97 = 0 THEN source || '/' || CAST(CAST(floor(doc_id/100.0) AS BIGINT) AS STRING) || '/Index.md'
      WHEN doc_id % 50 = 1 THEN 'n' || CAST(doc_id AS STRING) || '.md'
      ELSE source || '/n' || CAST(doc_id AS STRING) || '.md' END AS path,
 '# Note ' || CAST(doc_id AS STRING) || chr(10) || chr(10) || {body}
 || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '- [[n' || CAST(doc_id + doc_id % 7 AS STRING) || ']]' ELSE '' END
 || CASE WHEN doc_id % 11 = 0 THEN chr(10) || chr(10) || 'See [[Index|home]] and [[n' || CAST(doc_id + 1 AS STRING) || '#top]]' ELSE '' END
 || CASE WHEN doc_id % 13 = 0 THEN chr(10) || chr(10) || 'See [[missing' || CAST(doc_id AS STRING) || ']]' ELSE '' END
 || CASE WHEN doc_id % 17 = 0 THEN chr(10) || chr(10) || '[[name: x]] [[:space:]] [[https://e.example/a]] [[12]]' ELSE '' END
 || CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || 'Tags: #t' || CAST(doc_id % 4 AS STRING) || ' #' || lang ELSE '' END AS text,
 timestamp '2024-01-01 00:00:00' + {mtime} AS mtime
FROM {documents}"""

#: Changes of the notes: some move to another folder, some gain a link, some vanish; ``seq`` orders those of one path.
_CHANGES = """SELECT path, CASE WHEN doc_id % 10 = 5 THEN text || ' [[n' || CAST(doc_id + 3 AS STRING) || ']]' END AS text, doc_id AS seq
 FROM {notes} WHERE doc_id % 10 IN (4, 5) OR doc_id % 20 = 6
UNION ALL SELECT 'moved/' || path, text, doc_id FROM {notes} WHERE doc_id % 10 = 4"""

_RAW = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'h:' || CAST(doc_id AS STRING) WHEN doc_id % 41 = 0 THEN '_design/' || CAST(doc_id AS STRING) ELSE lower(path) END AS _id,
 CASE WHEN doc_id % 23 <> 0 THEN CASE WHEN doc_id % 19 = 3 THEN replace(path, '.md', '.pdf') ELSE path END END AS path,
 n_chars AS size, doc_id AS mtime, doc_id % 9 = 0 AS deleted, body
FROM {raw}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vault_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = f"array_join(transform(split(text, chr(10)), (l, i) -> {_LINE}), chr(10))"
    sql = _NOTES.format(body=body, mtime="make_interval(0,0,0,CAST(doc_id % 120 AS INT))", documents="{documents}")
    return spark.sql(sql, documents=table(spark, sf_dir, "documents"))


def note_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CHANGES, notes=vault_notes(spark, sf_dir))


def raw_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("text").alias("body"))
    notes = vault_notes(spark, sf_dir).select(F.col("doc_id").alias("k"), "path")
    return spark.sql(_RAW.format(raw="{raw}"), raw=docs.join(notes, docs.doc_id == notes.k).drop("k"))


def raw_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw documents with the blocks that each names."""
    children = F.expr("transform(sequence(0, cast(doc_id % 3 as int)), k -> 'h:' || cast(doc_id - doc_id % 4 + 4 * k as string))")
    return raw_docs(spark, sf_dir).withColumn("children", children)


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read of each live file: whole, cut, empty, missing; PDF files as base64 blocks."""
    from ..sources.notes import live_docs

    raw = raw_docs(spark, sf_dir)
    live = live_docs(raw).select("path")
    content = (
        F.when(F.col("doc_id") % 31 == 0, "Note not found").when(F.col("doc_id") % 29 == 0, "")
        .when(F.col("path").endswith(".pdf"), F.concat(F.base64(F.substring("body", 1, 50).cast("binary")), F.lit("\n"), F.base64(F.substring("body", F.lit(51), F.length("body")).cast("binary"))))
        .when(F.col("doc_id") % 7 == 0, F.substring("body", 1, 1000)).otherwise(F.col("body"))
    )
    return raw.select("doc_id", "path", content.alias("content"), F.octet_length("body").cast("long").alias("size")).join(live, "path", "left_semi")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve daily copies of the live files, each without some of them."""
    days = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("day")
    p = payloads(spark, sf_dir).select("doc_id", "path", "size", days).where("(doc_id + day) % 13 <> 0")
    return p.select(F.format_string("202401%02d-030000", "day").alias("snapshot"), "path", "size")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.array_join(F.slice(F.split("text", " "), 1, 4), " ").alias("query"))
    return q.union(spark.range(1).select(F.lit(-1).cast("long"), F.lit("zqxjkv-9931")))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes cut at blank lines: chunks that SQL can cut as well."""
    cut = vault_notes(spark, sf_dir).select("path", F.posexplode(F.split("text", "\n\n")).alias("ord", "text"))
    return cut.where("trim(text) <> ''")


#: Of a note's paragraphs those of so many characters are its wording; headings, tags and single items aren't.
WORDING = 120


def filed_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes, a third of them in folders that similarity leaves out."""
    folder = F.when(F.col("doc_id") % 6 == 0, "05-Archive/").when(F.col("doc_id") % 6 == 1, "03-Personal/Secrets/").otherwise("")
    return vault_notes(spark, sf_dir).withColumn("path", F.concat(folder, "path"))


def wording(notes: DataFrame) -> DataFrame:
    cut = notes.select("path", F.posexplode(F.split("text", "\n\n")).alias("ord", "text"))
    return cut.where(F.length("text") >= WORDING)


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "append").when(F.col("event_type") == "click", "prepend").when(F.col("event_type") == "purchase", "replace").when(F.col("event_type") == "signup", "write").otherwise("delete")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("n"), F.col("user_id").cast("string"), F.lit(".md")).alias("path"), kind.alias("op"), F.col("props").cast("string").alias("content"), F.lit("1").alias("old_text"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ops, every seventh of them a move instead."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.expr("concat('n', user_id + event_id % 11, '.md')").alias("to_path"))
    both = ops(spark, sf_dir).join(e, "seq")
    moves = F.col("seq") % 7 == 0
    return both.withColumn("op", F.when(moves, "move").otherwise(F.col("op"))).withColumn("to_path", F.when(moves, F.col("to_path")))


# The same in DuckDB SQL.
_duck = lambda s: s.replace("AS STRING", "AS VARCHAR")
SQL_NOTES = _duck(_NOTES).format(
    body=f"array_to_string(list_transform(string_split(text, chr(10)), lambda l, k: {_LINE.replace('i %', '(k-1) %')}), chr(10))",
    mtime="to_days(CAST(doc_id % 120 AS INTEGER))", documents="documents",
)
#: The notes after the changes; of rows with one path the last.
SQL_CHANGED = f"""SELECT path, text FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY v DESC, seq DESC) AS r FROM (
 SELECT path, text, doc_id AS seq, 0 AS v FROM first_notes UNION ALL SELECT path, text, seq, 1 FROM ({_duck(_CHANGES).format(notes="first_notes")}))) WHERE r = 1 AND text IS NOT NULL"""
SQL_RAW = _duck(_RAW).format(raw="(SELECT d.doc_id, d.n_chars, d.text AS body, v.path FROM documents d JOIN vault_notes v ON d.doc_id = v.doc_id)")
SQL_LIVE = "SELECT doc_id, path, size, mtime, body FROM raw_docs WHERE NOT starts_with(_id, 'h:') AND NOT starts_with(_id, '_') AND coalesce(path, '') <> '' AND NOT deleted"
SQL_PARAGRAPHS = "SELECT path, CAST(i - 1 AS INTEGER) AS ord, p[i] AS text FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT path, string_split(text, chr(10) || chr(10)) AS p FROM vault_notes)) WHERE trim(p[i], ' ') <> ''"
SQL_QUERIES = "SELECT item_id AS qid, array_to_string(string_split(text, ' ')[1:4], ' ') AS query FROM benchmark UNION ALL SELECT -1, 'zqxjkv-9931'"
SQL_FILED = "SELECT doc_id, path, text FROM vault_notes WHERE doc_id % 6 > 1"
SQL_WORDING = f"SELECT p.path, p.ord, p.text FROM paragraphs p JOIN filed f ON p.path = f.path WHERE length(p.text) >= {WORDING}"
