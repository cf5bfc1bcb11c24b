"""From raw documents to packed training sequences, in stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's documents.  All but the last
return the columns of documents as they came, whatever their names (but for
names that begin with ``__``).  Any column may be null; what a stage then does
stands with it.  No documents in, none out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notelake.llm import mixing, packing, simhash, toxicity
from notelake.shared import remove, shared_folder

#: Documents of a packed sequence, at most, so that no sequence consists of scraps.
MAX_DOCS = 64


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go.

    A row is judged by its text alone: repeated rows go or stay alike, a null id
    doesn't matter, a null text is empty and stays.
    """
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id.

    Groups are linked by a similarity of 0.8 or more of five-word shingles.  Null
    texts and texts without words are copies of each other.  Rows that share an
    id are documents of their own, unless they share the text; rows without an id
    stay.
    """
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources near their targets; a document stands as often as the mix takes it.

    Null is a source, the last; texts without words come with complete epochs
    only; rows without an id draw by their text, equal rows are taken one by one.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece of a document: its sequence and its place there; at most MAX_DOCS pieces a sequence.

    A null text is an empty document, which is its closing id; rows that repeat
    an id, and rows without one, are documents of their own.
    """
    return packing.pack_documents(docs, max_docs=MAX_DOCS)


STAGES = [("drop_toxic", drop_toxic), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]
#: SQL has neither the hashes nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is removed once the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        out = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            remove(spark, before)
        before = out
    return docs
