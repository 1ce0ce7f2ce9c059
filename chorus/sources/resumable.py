"""Per-key results that survive a crash: a manifest is written last.

Keys are dealt into waves by hash.  A wave's results go to a folder of its own below ``results``,
then one row for each of its keys to a folder of the same name below ``manifest``; the rename that
Spark's committer ends with makes the manifest whole or absent.  A key counts as stored when a
manifest names it, and only results of waves with a manifest are read, so what a crashed run left
half written is computed again and never read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def finished_waves(spark: SparkSession, path: str) -> list[str]:
    """Names of the waves whose manifest is whole (bounded by waves x runs)."""
    marks = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
    return sorted(f.getPath().getParent().getName() for f in found)


def stored_keys(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    waves = finished_waves(spark, path)
    return spark.read.parquet(*[f"{path}/manifest/{w}" for w in waves]).select(key) if waves else None


def missing(todo: DataFrame, path: str, key: str) -> DataFrame:
    """Rows of ``todo`` whose key is not stored."""
    done = stored_keys(todo.sparkSession, path, key)
    return todo if done is None else todo.join(done.distinct(), key, "left_anti")


def compute_missing(todo: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame], waves: int = 8) -> int:
    """Applies ``compute`` to the rows of missing keys, a wave at a time (it must return ``key``);
    the number of waves that were computed.  A wave that fails leaves the earlier ones stored."""
    spark = todo.sparkSession
    rows = missing(todo, path, key).where(F.col(key).isNotNull())
    count = 0
    for w in range(waves):
        part = rows.where(F.pmod(F.xxhash64(key), F.lit(waves)) == w)
        if part.isEmpty():
            continue
        name = f"wave-{uuid.uuid4().hex[:16]}"
        compute(part).write.parquet(f"{path}/results/{name}")
        # every key of the wave is done, also one without a result row
        part.select(key).distinct().write.parquet(f"{path}/manifest/{name}")
        count += 1
    return count


def read_results(spark: SparkSession, path: str) -> DataFrame:
    waves = finished_waves(spark, path)
    if not waves:
        raise ValueError(f"no finished wave below {path}")
    return spark.read.parquet(*[f"{path}/results/{w}" for w in waves])
