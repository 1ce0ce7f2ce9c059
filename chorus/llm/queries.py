"""The registered queries of the training-data operators: each applies one operator, with
production parameters, to its whole table.  ``ORACLES`` holds DuckDB SQL where SQL can
express the operator; the others are tested in ``tests/llm`` against brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm import codes, langid, lattice, linedup, mih, minhash, packing, pii, pivots, repack, resample, sharding, warc
from chorus.llm.common import read_table
from chorus.session import scratch_path


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, found again through the capture index and read."""
    return warc.archive_round_trip(spark, read_table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 16 shards whose counts are at most one apart."""
    docs = read_table(spark, sf_dir, "documents")
    out = sharding.shuffle_shards(docs, scratch_path(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents and the terms that disclose it."""
    return pii.report(pii.find(read_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations of every document, sampled without replacement."""
    docs = read_table(spark, sf_dir, "documents")
    return lattice.segmentations(docs, public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    table = read_table(spark, sf_dir, "embeddings")
    return mih.search(table, table.where(F.col("vec_id") % 20 == 0), k=20)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by five-word shingles, Jaccard 0.85."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return pivots.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later occurrences of repeated three-line windows."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linedup.dedup_lines(docs)


def op11_repacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 4096 tokens as best-fit and exchange find."""
    return repack.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as product codes of 16 parts."""
    return codes.compress(read_table(spark, sf_dir, "embeddings"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored towards the benchmark texts, five in a hundred drawn."""
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_sharding, op3_pii, op4_lattice, op5_language_id, op6_multi_index, op7_minhash, op8_pivots,
        op9_packing, op10_line_dedup, op11_repacking, op12_vector_codes, op13_importance,
    )
}
ORACLES = {
    "op1_warc": warc.ORACLE, "op10_line_dedup": linedup.ORACLE, "op12_vector_codes": codes.ORACLE, "op13_importance": resample.ORACLE,
}
