"""Postings of the index: where each term stands, in classes by how often, and searches that read only classes that can matter.

A class holds the postings of a term whose number of places lies in a fixed
range: 1 to FINE by themselves, beyond that by powers of two.  The range bounds
what a posting of the class can add to a score, whatever is added or deleted, so
``weights(term, cls, n)``, the number of postings of each class, is all that a
search needs to know before it reads any.  Nothing is sorted or ranked within a
term, so a term that stands everywhere is as evenly spread as any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Numbers of places that are classes by themselves.
FINE = 8


def class_of(tf: Column) -> Column:
    return F.when(tf <= FINE, tf).otherwise(FINE + 1 + F.floor(F.log2(tf / (FINE + 1)) + 1e-9)).cast("int")


def low_of(cls: Column) -> Column:
    """The fewest places of a posting of the class."""
    return F.when(cls <= FINE, cls).otherwise(F.pow(F.lit(2.0), cls - FINE - 1) * (FINE + 1)).cast("long")


def high_of(cls: Column) -> Column:
    """The most places of a posting of the class."""
    return F.when(cls <= FINE, cls).otherwise(low_of(cls + 1) - 1).cast("long")


def postings(chunks: DataFrame) -> DataFrame:
    """``(term, cls, path, ord, tf, len)`` of ``chunks(path, ord, text)``: each term of a chunk, how often it stands there, and of how many tokens."""
    tokens = chunks.select("path", "ord", T.tokenize(F.col("text")).alias("tokens")).select("path", "ord", F.size("tokens").alias("len"), F.explode("tokens").alias("term"))
    counts = tokens.groupBy("term", "path", "ord", "len").agg(F.count("*").cast("int").alias("tf"))
    return counts.select("term", class_of(F.col("tf")).alias("cls"), "path", "ord", "tf", "len")


def weights(own: DataFrame) -> DataFrame:
    """``(term, cls, n)``: how many postings a class has; counted before they are shuffled."""
    return own.groupBy("term", "cls").agg(F.count("*").alias("n"))


def freq_of(own: DataFrame) -> DataFrame:
    """``(term, n)``: in how many chunks a term stands, from the numbers of its classes."""
    return own.groupBy("term").agg(F.sum("n").alias("n"))


def wanted_classes(queries: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """``(qid, term, cls, n, read)`` for each class of each key term of a query: whether one of the k best can have a posting there.

    A term's classes, from the highest, that hold k postings together show that
    k chunks have at least the lowest of them in places; the best of these floors
    is the query's.  A class whose postings, with the most that all other terms
    can add, stay below the floor is not read.  A chunk at the floor or above has
    all its postings in classes that are read, so its sum is whole.
    """
    terms = queries.select("qid", F.explode(F.array_distinct(T.key_terms(F.col("query")))).alias("term"))
    each = terms.join(own.where("n > 0"), "term")
    term = Window.partitionBy("qid", "term")  # as many rows as a term has classes
    upto = F.sum("n").over(term.orderBy(F.desc("cls")))
    each = each.withColumn("floor", F.when(upto >= k, low_of(F.col("cls"))).otherwise(0)).withColumn("top", high_of(F.max("cls").over(term)))
    query = Window.partitionBy("qid")
    # Each term's top once: in the row of its highest class.
    first = F.row_number().over(term.orderBy(F.desc("cls"))) == 1
    each = each.withColumn("once", F.when(first, F.col("top")).otherwise(0))
    each = each.withColumn("others", F.sum("once").over(query) - F.col("top")).withColumn("floor", F.max("floor").over(query))
    return each.select("qid", "term", "cls", "n", (high_of(F.col("cls")) + F.col("others") >= F.col("floor")).alias("read"))


def search(queries: DataFrame, own: DataFrame, own_weights: DataFrame, k: int = 5) -> DataFrame:
    """The hits of ``retrieval.lexical_search``, read from postings: ``(qid, rank, path, ord, score)``.

    The work follows the postings of the queries' terms that can matter, not the
    chunks.  A query without terms, or with terms that stand nowhere, has no hits.
    """
    from .retrieval import top_k

    read = wanted_classes(queries, own_weights, k).where("read").select("qid", "term", "cls")
    sums = own.join(read, ["term", "cls"]).groupBy("qid", "path", "ord").agg((F.sum("tf") / 100).alias("score"))
    return top_k(sums, k).select("qid", "rank", "path", "ord", "score")


def skipped(queries: DataFrame, own_weights: DataFrame, k: int = 5) -> DataFrame:
    """One row: postings of the queries' terms, and how many of them a search doesn't read."""
    each = wanted_classes(queries, own_weights, k)
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.coalesce(F.sum(F.when(~F.col("read"), F.col("n"))), F.lit(0)).alias("skipped"))
