"""The operators over the supplied tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from . import chat, editprint, embed_dedup, kdmeans, licenses, merkle, mixing, packing, pii, simhash, sql, tokens, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = _table(spark, sf_dir, "pages"), shared_folder(spark, "warc")
    directory = warc.write_index(warc.write_archives(pages, folder), folder)
    records = warc.read_records(warc.lookup(directory, pages), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.digests(chat.format_conversations(turns))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokens.prefix_counts(_table(spark, sf_dir, "documents"), changes=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_components(_table(spark, sf_dir, "embeddings"))


def op9_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.similar_groups(editprint.edited_pairs(_table(spark, sf_dir, "documents")))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.with_changed_case(docs))


def op12_kdtree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdmeans.kmeans(_table(spark, sf_dir, "embeddings"))[0]


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_warc_capture_index, op3_chat_format, op4_best_fit_packing, op5_token_counts,
        op6_mix_sources, op7_license_scan, op8_embedding_near_dedup, op9_edit_fingerprints, op10_toxicity_chain,
        op11_merkle_manifest, op12_kdtree_clusters, op13_personal_data,
    )
}
ORACLE_SQL = {
    "op2_warc_capture_index": sql.OP2,
    "op3_chat_format": sql.OP3,
    "op6_mix_sources": sql.OP6,
    "op7_license_scan": sql.OP7,
    "op8_embedding_near_dedup": sql.OP8,
    "op11_merkle_manifest": sql.OP11,
    "op12_kdtree_clusters": sql.OP12,
    "op13_personal_data": sql.OP13,
}
