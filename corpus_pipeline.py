"""Training-corpus pipeline: documents -> identified -> line-deduplicated -> near-deduplicated
-> sanitised -> packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes each stage's result as Parquet below the shared
folder and hands the reread table to the next stage.  Near-duplicate matching and packing
have no SQL form, so ``ORACLE_SQL`` is None and ``tests/llm`` replays the stages by brute
force on small tables.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.llm import langid, linedup, minhash, packing, pii
from chorus.llm.common import read_table
from chorus.session import prepare, scratch_path


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models do not reject."""
    prepare(spark)
    return langid.identify(docs, langid.fit(docs), keep_rejected=False).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated windows; a document of which nothing is
    left goes."""
    prepare(spark)
    out = linedup.dedup_lines(docs)
    out = out.where(~((F.col("n_removed") > 0) & (F.trim("text") == "")))
    return _recount(out.select(*docs.columns))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``line_dedup`` and, by the same pass, texts without later occurrences of passages of 50
    words and more, which may stand on one line; a document of which nothing is left goes."""
    prepare(spark)
    out = linedup.dedup_lines(docs, passages=True)
    out = out.where(~((F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")))
    return _recount(out.select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, share: tuple[int, int] = minhash.SHARE) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id."""
    prepare(spark)
    gone = minhash.near_duplicates(docs, share=share).where(~F.col("kept")).select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked and disclosing terms generalised or removed."""
    prepare(spark)
    return _recount(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences in windows of 2048."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


NEAR = (80, 100)  # of the stage; 0.85 is the contract of op7

STAGES = [
    ("language_id", language_id),
    ("line_dedup", passage_dedup),
    ("near_dedup", partial(near_dedup, share=NEAR)),
    ("pii", mask_pii),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the pieces of the last one."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
