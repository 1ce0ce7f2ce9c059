"""Positions, top-n and pivots that stay balanced under key skew.

``row_number() over (partition by key)`` sends a whole key to one task; with a key
holding a third of the rows that task is the job.  The helpers here avoid that:

* :func:`position_within` computes the exact 0-based position of every row inside
  its key by range-partitioning on (key, order) - a hot key is split over many
  tasks - and adding per-partition offsets from a small count table.  The ranged
  rows are checkpointed once so both uses see the same partition ids.
* :func:`top_n_per_key` uses a ``row_number <= n`` filter, which Spark turns into a
  partial ``WindowGroupLimit`` before the shuffle, so at most ``n`` rows per key and
  map task are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chorus.session import checkpoint_dir

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index


def _cols(xs: Sequence[Column | str]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def position_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    out: str = "pos",
    num_partitions: int | None = None,
) -> DataFrame:
    """Exact 0-based position of each row within its ``keys`` group under ``order``.

    ``order`` must be a total order inside a key (end it with a unique column).
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_cols = [F.col(k) for k in keys]
    order_cols = _cols(order)
    checkpoint_dir(spark)
    # Range bounds come from sampling, which is seeded per execution; the partition
    # ids must be the same for the count table and the rows, so the ranged rows are
    # written once to the shared checkpoint folder (reliable, survives executor loss).
    ranged = (
        df.repartitionByRange(n, *key_cols, *order_cols)
        .sortWithinPartitions(*key_cols, *order_cols)
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
        .withColumn("_pid", F.shiftright(F.col("_mid"), _LOCAL_BITS))
        .withColumn("_loc", F.col("_mid") - F.shiftleft(F.col("_pid"), _LOCAL_BITS))
    )
    # one row per (partition, key) present: at most partitions + distinct keys rows
    pieces = ranged.groupBy("_pid", *keys).agg(F.min("_loc").alias("_first"), F.count(F.lit(1)).alias("_cnt"))
    w = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_cnt").over(w), F.lit(0)))
    pieces = pieces.select(
        F.col("_pid").alias("_ppid"), *[F.col(k).alias(f"_pk{i}") for i, k in enumerate(keys)], "_first", "_before"
    )
    cond = F.col("_pid") == F.col("_ppid")
    for i, k in enumerate(keys):  # null-safe: a null key is a group of its own
        cond = cond & F.col(k).eqNullSafe(F.col(f"_pk{i}"))
    joined = ranged.join(pieces, cond, "inner")
    return joined.withColumn(out, (F.col("_before") + F.col("_loc") - F.col("_first")).cast("long")).drop(
        "_mid", "_pid", "_loc", "_first", "_before", "_ppid", *[f"_pk{i}" for i in range(len(keys))]
    )


def prefix_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    value: str,
    how: str = "max",
    inclusive: bool = True,
    out: str = "prefix",
    num_partitions: int | None = None,
    keep_pieces: bool = False,
) -> DataFrame:
    """Running ``max`` / ``sum`` of ``value`` inside each key in ``order`` (inclusive or
    exclusive of the current row), without a window over a whole key.

    Same layout as :func:`position_within`: range partitions over (key, order), a
    per-(partition, key) summary whose own prefix over partitions is small, and a
    window inside each (partition, key) piece, whose size is bounded by a partition.
    ``keep_pieces`` keeps the piece column ``_pid`` so that a following scan over the
    same keys and order reuses the layout instead of ranging and checkpointing again.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fn = {"max": F.max, "sum": F.sum}[how]
    key_cols = [F.col(k) for k in keys]
    order_cols = _cols(order)
    if "_pid" in df.columns:  # pieces of an earlier scan over the same keys and order
        ranged = df
    else:
        checkpoint_dir(spark)
        ranged = (
            df.repartitionByRange(n, *key_cols, *order_cols)
            .sortWithinPartitions(*key_cols, *order_cols)
            .withColumn("_pid", F.shiftright(F.monotonically_increasing_id(), _LOCAL_BITS))
            .checkpoint(eager=True)
        )
    pieces = ranged.groupBy("_pid", *keys).agg(fn(value).alias("_pv"))
    wp = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        F.col("_pid").alias("_ppid"), *[F.col(k).alias(f"_pk{i}") for i, k in enumerate(keys)], fn("_pv").over(wp).alias("_before")
    )
    wl = Window.partitionBy("_pid", *keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = ranged.withColumn("_loc", fn(value).over(wl))
    cond = F.col("_pid") == F.col("_ppid")
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"_pk{i}"))
    j = local.join(pieces, cond, "inner")
    if how == "max":
        res = F.greatest(F.col("_before"), F.col("_loc"))
    else:
        res = F.when(F.col("_before").isNull() & F.col("_loc").isNull(), F.lit(None)).otherwise(
            F.coalesce(F.col("_before"), F.lit(0)) + F.coalesce(F.col("_loc"), F.lit(0))
        )
    res_df = j.withColumn(out, res).drop("_loc", "_ppid", "_before", *[f"_pk{i}" for i in range(len(keys))])
    return res_df if keep_pieces else res_df.drop("_pid")


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, out: str = "rn") -> DataFrame:
    """Rows ranked 1..n within each key (ties broken by ``order``); partial limit before
    the shuffle keeps hot keys cheap."""
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= n).withColumn(out, F.col(out).cast("long"))


def top_n_wide(df: DataFrame, key: str, order: Sequence[Column | str], n: int, fields: dict[str, str]) -> DataFrame:
    """First ``n`` rows per key pivoted wide: ``{prefix}_{i}`` for each field, i = 0..n-1."""
    ranked = top_n_per_key(df, [key], order, n, "_rn")
    aggs = []
    for i in range(n):
        for prefix, col in fields.items():
            aggs.append(F.max(F.when(F.col("_rn") == i + 1, F.col(col))).alias(f"{prefix}_{i}"))
    return ranked.groupBy(key).agg(*aggs)
