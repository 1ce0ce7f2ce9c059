"""Aggregates that are joined back on their own key leave the hot key to adaptive execution."""

import pytest
from pyspark.sql import functions as F

from chorus.llm.common import own
from chorus.operators.graph import _star_min

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    old = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def executed(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def hot(spark, n=200_000):
    return spark.range(n, numPartitions=8).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(7)).alias("key"), F.col("id").alias("v"))


def test_own_keeps_an_exchange_and_the_join_is_split(small_partitions):
    rows = hot(small_partitions)
    agg = rows.groupBy("key").agg(F.min("v").alias("m")).select(own("key").alias("k"), "m")
    out, plan = executed(rows.join(agg, F.col("key") == F.col("k")).select("key", "v", "m"))
    assert len(out) == 200_000 and plan.count("Exchange hashpartitioning") == 3 and "skew=true" in plan


def test_star_minimum_is_split(small_partitions):
    pairs = hot(small_partitions)
    out, plan = executed(pairs.join(_star_min(pairs), F.col("key") == F.col("k")).select("v", "m"))
    assert len(out) == 200_000 and plan.count("Exchange hashpartitioning") == 3 and "skew=true" in plan
