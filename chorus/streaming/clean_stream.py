"""The stateless text functions on a streaming source.

The reference has no streaming; its row functions are stateless column
expressions, so the same cleaning, emoji and token expressions apply to a
``readStream`` unchanged.  This module wires them to a file stream of posts and a
parquet sink whose checkpoint lives in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from chorus.functions import text as tx


def clean_posts_stream(stream: DataFrame, id_col: str, text: str, emoji: Sequence[tuple[str, str]] | None = None, min_length: int = 0) -> DataFrame:
    """(id, tweet, tokens) for each arriving row: cleaned (and optionally emoji as text),
    short texts dropped, tokens attached."""
    cleaned = tx.clean_text(text)
    if emoji:
        cleaned = tx.emoji_to_text(cleaned, emoji)
    out = stream.select(F.col(id_col), cleaned.alias("tweet"))
    if min_length:
        out = out.filter(tx.text_length("tweet") >= min_length)
    return out.withColumn("tokens", tx.tokenise("tweet"))


def read_parquet_stream(spark: SparkSession, directory: str, schema, file_glob: str | None = None, max_files: int = 1) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    return reader.parquet(directory)


def write_parquet_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
