"""Two-pass external shuffle into shards.

Pass one scatters the rows by a seeded hash into buckets that fit in memory (about
``BUCKET_BYTES`` of text each).  Pass two takes one bucket at a time, puts its rows into a
canonical order, permutes them with a Fisher-Yates shuffle seeded by (seed, bucket) and
writes them.  Buckets follow one another, so with the number of rows before each bucket every
row knows its place in the whole, and the shards are equal cuts of it: counts are at most
one apart (law ``rows``), slots are gapless.

Defined results: a null text has size 1 and checksum 0; rows that repeat doc_id and text land
in one bucket and are placed one by one; null doc_ids are scattered by their text; an empty
table gives no rows; columns named shard or slot in the input are replaced.

Scale: the text crosses one shuffle; bucket counts are added up in two steps (inside groups
of 1024 buckets, then over the groups) and broadcast, 16 bytes a bucket.  A task takes a run of
consecutive buckets, one in memory at a time, so it writes to one or two shards: every file and
folder that a task makes starts a process on its executor where Hadoop has no native library.  The same seed gives the same shards at any number
of partitions, so a lost task is repeated with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import groups

SHARDS = 16
SEED = 20240229
BUCKET_BYTES = 8 << 20
GROUP = 1024


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, before): rows in smaller buckets; no window holds more than a group."""
    c = counts.withColumn("g", F.floor(F.col("bucket") / GROUP))
    inside = c.withColumn("inside", F.sum("n").over(Window.partitionBy("g").orderBy("bucket")) - F.col("n"))
    per = c.groupBy("g").agg(F.sum("n").alias("gn"))
    per = per.select(F.col("g").alias("g2"), (F.sum("gn").over(Window.orderBy("g")) - F.col("gn")).alias("base"))
    return inside.join(per, F.col("g") == F.col("g2")).select("bucket", (F.col("inside") + F.col("base")).alias("before"))


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """Order of n rows; numpy's ``shuffle`` is Fisher-Yates."""
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)
    return order


def cut_points(place: np.ndarray, rows: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of places among ``rows``, the first shards one longer if needed."""
    small, extra = divmod(rows, shards)
    long = extra * (small + 1)
    front = place < long
    rest = (place - long) // max(small, 1)
    shard = np.where(front, place // (small + 1), extra + rest)
    slot = np.where(front, place % (small + 1), (place - long) - rest * small)
    return shard, slot


def shuffle_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` below ``path`` as ``shard=N`` folders with a ``slot`` column; what was
    written."""
    base = docs.drop("shard", "slot")
    cols = [f"_c{i}" for i in range(len(base.columns))]
    inner = base.toDF(*cols)
    c_id, c_text = cols[base.columns.index(id_col)], cols[base.columns.index(text_col)]
    size = F.sum(F.coalesce(F.octet_length(c_text), F.lit(0)) + 1)
    total, rows = inner.agg(size, F.count(F.lit(1))).first()
    buckets = max(4 * shards, -(-(total or 0) // bucket_bytes))
    key = F.xxhash64(F.lit(seed), F.col(c_id), F.col(c_text))
    dealt = inner.withColumn("_o", key).withColumn("_b", F.pmod(F.xxhash64("_o", F.lit(seed)), F.lit(buckets)))
    before = _offsets(dealt.groupBy(F.col("_b").alias("bucket")).agg(F.count(F.lit(1)).alias("n")))

    def run(batches):
        for t in groups(batches, ["_b"]):
            t = t.combine_chunks()
            t = t.take(pa.compute.sort_indices(t, sort_keys=[("_o", "ascending"), (c_id, "ascending")]))
            order = fisher_yates(t.num_rows, seed, t.column("_b")[0].as_py())
            shard, slot = cut_points(t.column("before")[0].as_py() + np.arange(t.num_rows), rows, shards)
            out = t.take(pa.array(order)).select(cols)
            out = out.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(slot, pa.int64()))
            yield from out.to_batches(max_chunksize=2000)

    schema = ", ".join(f"{c} {t}" for c, t in inner.dtypes) + ", shard int, slot long"
    parts = min(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    runs = dealt.repartitionById(parts, F.expr(f"cast(_b * {parts} div {buckets} as int)"))
    placed = runs.join(F.broadcast(before), F.col("_b") == F.col("bucket")).sortWithinPartitions("_b")
    out = placed.mapInArrow(run, schema)
    out.write.partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.schema(out.schema).parquet(path)
    return back.select(*[F.col(c).alias(n) for c, n in zip(cols, base.columns)], "shard", "slot")
