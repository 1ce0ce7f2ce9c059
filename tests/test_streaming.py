"""The streaming form of the cleaning gives the batch result."""

from pyspark.sql import functions as F

from chorus.functions import text as tx
from chorus.session import scratch_path
from chorus.streaming.clean_stream import clean_posts_stream, read_parquet_stream, write_parquet_stream
from conftest import SF_SMALL


def test_stream_cleaning_equals_batch(spark):
    batch = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    stream = read_parquet_stream(spark, SF_SMALL, batch.schema, file_glob="documents.parquet")
    out = clean_posts_stream(stream, "doc_id", "text", min_length=10)
    path, ckpt = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ckpt")
    q = write_parquet_stream(out, path, ckpt)
    q.processAllAvailable()
    q.stop()
    got = {r["doc_id"]: r["tweet"] for r in spark.read.parquet(path).collect()}
    want = batch.select("doc_id", tx.clean_text("text").alias("t")).filter(F.length("t") >= 10)
    assert got == {r["doc_id"]: r["t"] for r in want.collect()}
