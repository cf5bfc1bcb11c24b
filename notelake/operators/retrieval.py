"""Ranking chunks for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

#: Queries of a batch that are sent to every task; more go in several batches.
MAX_QUERIES = 10_000
#: Queries that a task scores at once against a block of chunks.
QUERY_TILE = 500
#: Chunks of a block that a task scores at once.
CHUNK_BLOCK = 2000
#: First characters of a name query by which names are met.
GRAM = 6


def doc_freq(chunks: DataFrame) -> DataFrame:
    """``(term, n)``: in how many chunks a term stands.  Counted before it is shuffled, so frequent terms don't weigh."""
    return chunks.select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def expand_query(queries: DataFrame, stems: DataFrame | None = None, synonyms: dict[str, list[str]] | None = None) -> DataFrame:
    """``queries(qid, query)`` with ``terms``: tokens, those of their synonyms and, where given, of stems(term, stem); sorted, distinct."""
    synonyms = T.SYNONYMS if synonyms is None else synonyms
    words = queries.select("qid", F.explode(T.tokenize(F.col("query"))).alias("term")).distinct()
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.lit(" ".join(v)))])
    every = words.union(words.select("qid", F.explode(T.tokenize(table[F.col("term")]))))
    if stems is not None:
        every = every.union(words.join(stems, "term").select("qid", F.explode(T.tokenize(F.col("stem")))))
    terms = every.groupBy("qid").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    both = queries.join(terms.withColumnRenamed("qid", "q"), F.col("qid") == F.col("q"), "left").drop("q")
    return both.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def holding(names: DataFrame, asked: DataFrame) -> DataFrame:
    """Distinct ``(qid, path)`` where the lower-case ``low`` of ``names(path, low)`` contains ``q`` of ``asked(qid, q)``.

    An equi-join: a string that contains ``q`` contains its first characters
    (GRAM of them, or all), so names are met by their substrings of that many
    and then tested.  Names are short; an empty or null ``q`` is in none.
    """
    asked = asked.where("length(q) > 0").withColumn("gram", F.substring("q", 1, GRAM))
    lengths = sorted(r["n"] for r in asked.select(F.length("gram").alias("n")).distinct().collect())  # at most GRAM
    none, size = F.array().cast("array<string>"), F.length("low")

    def parts(n: int) -> Column:
        return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring("low", i, F.lit(n)))).otherwise(none)

    cut = names.select("path", "low", F.explode(F.array_distinct(F.concat(none, *map(parts, lengths)))).alias("gram"))
    return cut.join(asked, "gram").where(F.contains("low", F.col("q"))).select("qid", "path").distinct()


def candidates(expanded: DataFrame, notes: DataFrame, max_candidates: int = 20) -> DataFrame:
    """``(qid, path, stage, rank)``, at most ``max(60, max_candidates)`` a query, in three stages.

    First the ``max_candidates`` notes, by path, whose name holds the query or
    its terms in a row; then the others that share words with it, by their
    number; then the others whose text contains a term of more than two letters.

    Every join is on equal keys.  A term consists of a token's characters, so a
    text that contains it has a token that does: terms are looked up in the
    corpus' distinct tokens, not in texts.  Of notes that no query can tell
    apart (the same words in the name, the same term in the text) only the first
    ``cap`` by path can get in, so no more of them leave a task.
    """
    cap = max(60, max_candidates)
    by_path = lambda key: Window.partitionBy(key).orderBy("path")
    names = notes.select("path", F.lower(T.file_name(F.col("path"))).alias("low"))
    terms = expanded.select("qid", F.explode("terms").alias("term"))

    whole = expanded.select("qid", F.explode(F.array(F.lower("query"), F.array_join("terms", " "))).alias("q")).distinct()
    first = holding(names, whole).withColumn("r", F.row_number().over(by_path("qid"))).where(F.col("r") <= max_candidates)
    first = first.select("qid", "path", F.lit(1).alias("stage"), F.lit(0).alias("overlap"))

    words = names.select("path", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit("[a-z0-9]+"), F.lit(0)))).alias("term"))
    shared = words.join(terms.select("term").distinct(), "term", "left_semi").groupBy("path").agg(F.array_sort(F.collect_set("term")).alias("shared"))
    alike = shared.withColumn("r", F.row_number().over(by_path("shared"))).where(F.col("r") <= cap).drop("r")
    overlap = alike.select("shared").distinct().select("shared", F.explode("shared").alias("term")).join(terms, "term")
    overlap = overlap.groupBy("qid", "shared").agg(F.count("*").cast("int").alias("overlap"))
    second = overlap.join(alike, "shared").select("qid", "path", F.lit(2).alias("stage"), "overlap")

    tokens = notes.select("path", F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("token"))
    known = tokens.select(F.col("token").alias("path"), F.col("token").alias("low")).distinct()
    long = terms.where("length(term) > 2")
    inside = holding(known, long.select(F.col("term").alias("qid"), F.col("term").alias("q")).distinct())
    found = tokens.join(inside.select(F.col("qid").alias("term"), F.col("path").alias("token")), "token").select("term", "path")
    # The dense rank counts a note once, however many of its tokens hold the term.
    found = found.withColumn("r", F.dense_rank().over(by_path("term"))).where(F.col("r") <= cap).select("term", "path").distinct()
    third = found.join(long, "term").select("qid", "path", F.lit(3).alias("stage"), F.lit(0).alias("overlap")).distinct()

    best = first.union(second).union(third).groupBy("qid", "path").agg(F.min(F.struct("stage", "overlap")).alias("s"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("s.stage", F.desc("s.overlap"), "path"))
    return best.withColumn("rank", rank).where(F.col("rank") <= cap).select("qid", "path", F.col("s.stage").alias("stage"), "rank")


def tfidf(expanded: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(qid, path, ord, tfidf)``: the score of every chunk of each query's notes, ``found(qid, path)``; ``chunks(path, ord, text)``.

    ``idf = ln(1 + N / (1 + df))`` over a query's candidates; the score is the sum of
    ``tf idf`` over its terms, divided by their number, and 0 without tokens.
    A chunk is tokenised once, whatever number of queries want it, and only the
    counts of terms that some query has are joined with the candidates.
    """
    terms = expanded.select("qid", F.size("terms").alias("m"), F.explode("terms").alias("term"))
    tokens = chunks.select("path", "ord", T.tokenize(F.col("text")).alias("tokens")).select("path", "ord", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    tf = tokens.join(terms.select("term").distinct(), "term", "left_semi").groupBy("path", "ord", "len", "term").agg(F.count("*").alias("c"))
    pairs = found.join(chunks.select("path", "ord"), "path")
    n = pairs.groupBy("qid").agg(F.count("*").alias("N"))
    # A query has few candidates, so few rows share a query and a term.
    df = F.count("*").over(Window.partitionBy("qid", "term"))
    hits = found.join(tf, "path").join(terms, ["qid", "term"]).withColumn("df", df).join(n, "qid")
    idf = F.log(1 + F.col("N") / (1 + F.col("df")))
    scored = hits.groupBy("qid", "path", "ord").agg((F.sum(F.col("c") / F.col("len") * idf) / F.first("m")).alias("tfidf"))
    return pairs.join(scored, ["qid", "path", "ord"], "left").fillna(0.0, ["tfidf"])


def hybrid(score: Column, cosine: Column, alpha: float = 0.6) -> Column:
    """``alpha`` of the lexical score and the rest of the cosine; the lexical score alone without vectors."""
    return F.when(cosine.isNull(), score).otherwise(alpha * score + (1 - alpha) * F.greatest(F.lit(0.0), cosine))


def name_boost(name: Column, terms: Column) -> Column:
    """1.35 if the name contains a term of more than two letters."""
    return F.when(F.exists(terms, lambda t: (F.length(t) > 2) & F.contains(F.lower(name), t)), 1.35).otherwise(1.0)


def boost(level: Column, heading: Column, terms: Column, age_days: Column, backlinks: Column, ctype: Column) -> Column:
    """What is added for the heading's level and words, freshness, backlinks and the chunk's type."""
    by_level = F.when(level == 1, 0.15).when(level == 2, 0.10).when(level == 3, 0.05).otherwise(0.0)
    shared = F.when(F.size(terms) > 0, 0.20 * F.size(F.array_intersect(terms, T.tokenize(F.coalesce(heading, F.lit(""))))) / F.size(terms)).otherwise(0.0)
    fresh = F.when(age_days.isNull(), 0.0).otherwise(0.10 * F.exp(-F.greatest(age_days, F.lit(0.0)) / 60))
    linked = F.when(backlinks > 0, 0.08 * F.log1p(backlinks.cast("double")) / F.log(F.lit(51.0))).otherwise(0.0)
    kind = F.when(ctype.isin("code", "table"), 0.02).when(ctype == "list", 0.01).otherwise(0.0)
    return by_level + shared + fresh + linked + kind


def top_k(scored: DataFrame, k: int, key: str = "qid") -> DataFrame:
    """The k best of each key with their rank; ties by path and ord.  Spark cuts to k before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "path", "ord"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def rag_search(queries: DataFrame, notes: DataFrame, metadata: DataFrame, chunker, now: Column, embedder: V.Embedder | None = None, k: int = 5, alpha: float = 0.6, max_candidates: int = 20, checkpoint=lambda df: df) -> DataFrame:
    """The whole pipeline: expansion, candidates, chunks, hybrid score, boosts, the k best of each query.

    ``notes(path, text)``, ``metadata(path, mtime, backlinks)``.  The candidates
    and their chunks are read several times: ``checkpoint`` keeps them.
    """
    expanded = checkpoint(expand_query(queries))
    found = checkpoint(candidates(expanded, notes, max_candidates).select("qid", "path"))
    wanted = notes.join(found.select("path").distinct(), "path", "left_semi").where(F.length(T.strip(F.col("text"))) >= 20)
    own = checkpoint(chunker(wanted))
    chunks = found.join(own, "path")
    scored = chunks.join(tfidf(expanded, found, own), ["qid", "path", "ord"]).join(expanded.select("qid", "query", "terms"), "qid")
    if embedder:
        texts = V.embed(own.select(F.sha1("text").alias("h"), "text").dropDuplicates(["h"]), embedder, "h", "text")
        asked = V.embed(queries, embedder, "qid", "query").withColumnRenamed("vec", "qvec")
        scored = scored.withColumn("h", F.sha1("text")).join(texts, "h").join(asked, "qid").withColumn("sem", V.cosine(F.col("vec"), F.col("qvec"))).drop("h", "vec", "qvec")
    else:
        scored = scored.withColumn("sem", F.lit(None).cast("double"))
    scored = scored.join(metadata.select("path", "mtime", "backlinks"), "path", "left")
    age = (F.unix_timestamp(now) - F.unix_timestamp("mtime")) / 86400
    total = hybrid(F.col("tfidf"), F.col("sem"), alpha) * name_boost(T.file_name(F.col("path")), F.col("terms"))
    total = total + boost(F.col("hlevel"), F.col("heading"), F.col("terms"), age, F.coalesce("backlinks", F.lit(0)), F.col("ctype"))
    best = top_k(scored.withColumn("score", total), k)
    return best.select("qid", "rank", "path", "ord", "heading", "hlevel", "ctype", T.excerpt(F.col("text")).alias("text"), "score", "sem")


def _search_batch(asked: DataFrame, tokens: DataFrame, df: DataFrame, n_chunks: int, embedder: V.Embedder, k: int, alpha: float) -> DataFrame:
    """``(qid, path, ord, score, sem)``: what may be among the k best of a batch of queries, from each task."""
    idf = F.log(1 + F.lit(n_chunks) / (1 + F.coalesce("n", F.lit(0))))
    weights = asked.select("qid", F.explode("terms").alias("term")).join(df, "term", "left").select("qid", "term", idf.alias("idf"))
    of: dict[int, dict[str, float]] = {}
    for r in weights.collect():
        of.setdefault(r["qid"], {})[r["term"]] = r["idf"]
    rows = asked.orderBy("qid").collect()
    vecs = np.asarray(embedder(pd.Series([f":: {r['query']}" for r in rows])), np.float64) if rows else np.zeros((0, 1))
    terms = sorted({t for r in rows for t in r["terms"]})
    col = {t: i for i, t in enumerate(terms)}
    mean = np.array([np.mean([of[r["qid"]][t] for t in r["terms"]]) / (max(of[r["qid"]].values()) or 1) for r in rows])
    qids = np.array([r["qid"] for r in rows], np.int64)
    norm = np.linalg.norm(vecs, axis=1)
    # The queries of each term, for each tile of queries: where they begin, and which they are.
    asks = []
    for at in range(0, len(rows), QUERY_TILE):
        pair = sorted((col[t], i) for i, r in enumerate(rows[at : at + QUERY_TILE]) for t in r["terms"])
        own_terms, own = (np.array(x, np.int64) for x in (zip(*pair, strict=True) if pair else ((), ())))
        asks.append((np.searchsorted(own_terms, np.arange(len(terms) + 1)), own))
    schema = "qid long, path string, ord int, score double, sem double"

    def block(b: pa.RecordBatch, known: pa.Array, names: ahocorasick.Automaton) -> Iterator[pa.RecordBatch]:
        tokens, n = b.column("tokens"), b.num_rows
        size = tokens.value_lengths().to_numpy().astype(np.int64)
        # (chunk, term) of each token that some query has, with its number there.
        term = pc.index_in(tokens.flatten(), known)
        has = np.flatnonzero(term.is_valid().to_numpy(zero_copy_only=False))
        pair = np.repeat(np.arange(n), size)[has] * len(terms) + term.take(pa.array(has)).to_numpy().astype(np.int64)
        pair, count = np.unique(pair, return_counts=True)
        where = [f"{p} {h or ''}".lower() for p, h in zip(b.column("path").to_pylist(), b.column("heading").to_pylist(), strict=True)]
        named = np.array(sorted({i * len(terms) + j for i, w in enumerate(where) for _, j in names.iter(w)}), np.int64)
        m = np.asarray(b.column("vec").flatten(), np.float64).reshape(n, -1)
        length = np.linalg.norm(m, axis=1)
        level = b.column("hlevel").to_numpy(zero_copy_only=False)
        level = np.select([level == 1, level == 2], [0.15, 0.10], 0.0)

        def spread(pair: np.ndarray, value: np.ndarray, first: np.ndarray, own: np.ndarray, out: np.ndarray) -> np.ndarray:
            """Adds the value of each (chunk, term) to the chunk's place of each query that has the term."""
            row, j = np.divmod(pair, len(terms))
            times = first[j + 1] - first[j]
            start = np.cumsum(times) - times
            q = own[np.arange(times.sum()) - np.repeat(start - first[j], times)]
            np.add.at(out, (np.repeat(row, times), q), np.repeat(value, times))
            return out

        for at, (first, own) in zip(range(0, len(rows), QUERY_TILE), asks, strict=True):
            q = slice(at, at + QUERY_TILE)
            sem = np.clip(m @ vecs[q].T / np.where(length > 0, length, 1)[:, None] / np.where(norm[q] > 0, norm[q], 1)[None, :], 0, 1)
            places = spread(pair, count, first, own, np.zeros(sem.shape, np.int32))
            is_named = spread(named, np.ones(len(named), np.int32), first, own, np.zeros(sem.shape, np.int32)) > 0
            lex = np.minimum(1, places / np.maximum(size, 1)[:, None]) * mean[q][None, :]
            score = (alpha * lex + (1 - alpha) * sem) * np.where(is_named, 1.35, 1.0) + level[:, None]
            # A tie on the k-th place is settled by the window, so all that tie go on.
            last = min(k, n) - 1
            kth = -np.partition(-score, last, axis=0)[last]
            i, j = np.nonzero(score >= kth[None, :])
            at_i = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(qids[q][j]), b.column("path").take(at_i), b.column("ord").take(at_i), pa.array(score[i, j]), pa.array(sem[i, j])], ["qid", "path", "ord", "score", "sem"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = pa.array(terms, pa.string()), ahocorasick.Automaton()
        for t, j in col.items():
            names.add_word(t, j)
        names.make_automaton()
        for whole in batches:
            for at in range(0, whole.num_rows if rows else 0, CHUNK_BLOCK):
                yield from block(whole.slice(at, CHUNK_BLOCK), known, names)

    return tokens.mapInArrow(each, schema)


def index_search(queries: DataFrame, chunks: DataFrame, df: DataFrame, n_chunks: int, embedder: V.Embedder, k: int = 5, alpha: float = 0.6) -> DataFrame:
    """Over the stored index: ``chunks(path, ord, heading, hlevel, ctype, text, vec)``.

    Queries go to every task in batches of about MAX_QUERIES, dealt by their id,
    with their vectors and term weights; a task scores its chunks in blocks and
    keeps the k best of each query, of which only the score is shuffled.  Terms
    are counted only where a chunk and a query share them: a task holds
    CHUNK_BLOCK x QUERY_TILE numbers, whatever the number of terms.  Texts are
    joined to what is left.
    """
    asked = queries.select("qid", "query", F.array_distinct(T.key_terms(F.col("query"))).alias("terms")).where(F.size("terms") > 0)
    batches = -(-asked.count() // MAX_QUERIES) or 1
    tokens = chunks.where("vec is not null").select("path", "ord", "heading", "hlevel", "vec", T.tokenize(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    found = None
    for batch in range(batches):
        own = asked.where(F.pmod(F.xxhash64("qid"), F.lit(batches)) == batch)
        part = _search_batch(own, tokens, df, n_chunks, embedder, k, alpha)
        found = part if found is None else found.union(part)
    best = top_k(found, k)
    texts = chunks.select(F.col("path").alias("p"), F.col("ord").alias("o"), "heading", "hlevel", "ctype", "text")
    hits = best.join(texts, (F.col("path") == F.col("p")) & (F.col("ord") == F.col("o")))
    return hits.select("qid", "path", "ord", "heading", "hlevel", "ctype", "text", "score", "sem", "rank")


def relevance_floor(hits: DataFrame, queries: DataFrame, sem_floor: float = 0.62) -> DataFrame:
    """Hits of those queries whose best hit holds a key term as a whole token or the query as it is, or is near enough."""
    best = hits.where("rank = 1").join(queries, "qid")
    seen = F.concat_ws(" ", "text", "path", "heading")
    term = F.arrays_overlap(T.tokenize(seen), T.key_terms(F.col("query")))
    as_is = (F.length(F.trim("query")) > 0) & F.contains(F.lower(seen), F.lower(F.trim("query")))
    good = best.where(term | as_is | (F.coalesce("sem", F.lit(0.0)) >= sem_floor)).select("qid")
    return hits.join(good, "qid", "left_semi")


def lexical_search(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """Without vectors: the number of places of a query's key terms, a hundredth of it the score; the k best."""
    terms = queries.select("qid", F.explode(F.array_distinct(T.key_terms(F.col("query")))).alias("term"))
    tokens = chunks.select("path", "ord", F.explode(T.tokenize(F.col("text"))).alias("term"))
    # Only terms that some query has; counted per chunk before the queries are joined.
    counts = tokens.join(terms.select("term").distinct(), "term", "left_semi").groupBy("path", "ord", "term").agg(F.count("*").alias("c"))
    sums = counts.join(terms, "term").groupBy("qid", "path", "ord").agg((F.sum("c") / 100).alias("score"))
    return top_k(sums, k).select("qid", "rank", "path", "ord", "score")


def neighbors(hits: DataFrame, linked: DataFrame) -> DataFrame:
    """Hits of topics with a flag: whether ``linked(dst)``, what the index note links to, has the note."""
    known = linked.select(F.col("dst").alias("d")).distinct()
    return hits.join(known, hits.path == known.d, "left").withColumn("already", F.col("d").isNotNull()).drop("d")
