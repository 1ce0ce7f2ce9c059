import zlib
from collections import Counter

import numpy as np
from common_llm import ROWS, SF, edge_docs, empty_docs

from chorus.llm import sharding
from chorus.session import scratch_path


def check(rows, n, shards=16):
    count = Counter(s for s, _ in rows)
    assert len(rows) == n and max(count.values()) - min(count[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(x for y, x in rows if y == s) == list(range(count[s]))


def test_shards_are_equal_and_hold_every_row(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.shuffle_shards(docs, scratch_path(spark, "t"), bucket_bytes=100_000)
    got = out.collect()
    check([(r["shard"], r["slot"]) for r in got], docs.count())
    assert {(r["doc_id"], zlib.crc32(r["text"].encode())) for r in got} == {(r["doc_id"], zlib.crc32(r["text"].encode())) for r in docs.collect()}
    # a shuffle: neighbours are not neighbours any more
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15


def test_same_seed_same_shards_at_any_partitioning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    place = lambda d, seed: {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle_shards(d, scratch_path(spark, "t"), seed=seed).collect()}
    a = place(docs, 1)
    assert a == place(docs.repartition(7), 1) and a != place(docs, 2)


def test_edges(spark):
    docs = edge_docs(spark)
    out = sharding.shuffle_shards(docs, scratch_path(spark, "t"), shards=4)
    assert out.columns == [c for c in docs.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    got = out.collect()
    check([(r["shard"], r["slot"]) for r in got], len(ROWS), 4)
    assert Counter(str(r["text"]) for r in got) == Counter(str(t) for _, t, _ in ROWS)
    assert sharding.shuffle_shards(empty_docs(spark), scratch_path(spark, "t")).count() == 0


def test_fisher_yates_is_a_permutation():
    assert sorted(sharding.fisher_yates(100, 1, 2)) == list(range(100))
    assert (sharding.fisher_yates(100, 1, 2) != sharding.fisher_yates(100, 1, 3)).any()


def test_a_task_writes_to_neighbouring_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, put_together = scratch_path(spark, "t"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(put_together, "false")
    try:
        sharding.shuffle_shards(docs, path, bucket_bytes=20_000)
    finally:
        spark.conf.unset(put_together)
    written = spark.read.parquet(path).select("shard", "_metadata.file_name").distinct().count()
    assert written <= parts + sharding.SHARDS
