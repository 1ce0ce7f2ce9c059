"""Helpers shared by the operators: table reads, cut lineage, streamed groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def own(c: Column | str) -> Column:
    """An integer key re-expressed, so that a join on an aggregated side gets an exchange
    of its own; adaptive execution splits a hot key only between two such exchanges.  (Adding
    0 would be simplified away, and with it the exchange.)"""
    return (F.col(c) if isinstance(c, str) else c).bitwiseXOR(F.lit(0))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal (non-null integer) keys as one table each; the input
    partition is sorted by the keys, so only one group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = np.stack([b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in keys], 1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(k)]):
            if held and tuple(k[lo]) != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = tuple(k[lo])
    if held:
        yield pa.Table.from_batches(held)


def by_group(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """``fn(table) -> iterator of record batches`` per key, streamed: rows are dealt and
    sorted by the keys and one group is in memory at a time."""

    def run(batches):
        for t in groups(batches, keys):
            yield from fn(t)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def batch(schema: pa.Schema, **cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)
