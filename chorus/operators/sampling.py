"""Deterministic sampling and splitting.

Every random choice is the md5 of a stable id and the seed, never ``rand()``, so results
do not depend on partitioning or task retries, and any engine can repeat them.

* :func:`sample_per_key` - ``n`` draws per key with replacement: draw ``i`` takes the
  row with the smallest ``md5(id:i:seed)``; that is one partial aggregation,
  so a hot key is combined map-side.
* :func:`stratified_split` / :func:`stratified_folds` - exact per-label sizes from the
  skew-safe position of each row inside its label in hash order.
* :func:`weighted_bootstrap` - ``n`` draws with replacement, probability proportional
  to weight: cumulative weights in id order (range-partitioned prefix sums), ``n``
  seeded uniforms, and an interval join done as an equi-join on bucket numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.operators.ranking import _LOCAL_BITS, position_within
from chorus.session import checkpoint_dir

_UNITS = 1_000_000.0


def _digest(*cols) -> F.Column:
    """md5 of the values joined by colons."""
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))


def _uniform(*cols) -> F.Column:
    """A uniform double in [0, 1): the first 48 bits of the digest."""
    return F.conv(F.substring(_digest(*cols), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def sample_per_key(df: DataFrame, key: str, id_col: str, n: int = 2, seed: int = 42, columns: Sequence[str] = ()) -> DataFrame:
    """(key, draw, id, *columns): ``n`` draws per non-null key, with replacement."""
    rest = [c for c in columns if c not in (key, id_col)]
    aggs = [
        F.min(F.struct(_digest(F.col(id_col), F.lit(i), F.lit(seed)).alias("_h"), F.col(id_col).alias("_id"), *[F.col(c) for c in rest])).alias(f"_d{i}")
        for i in range(n)
    ]
    picked = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)
    draws = F.array(*[F.struct(F.lit(i).alias("draw"), F.col(f"_d{i}").alias("r")) for i in range(n)])
    ex = picked.select(key, F.inline(draws))
    return ex.select(key, F.col("draw").cast("long").alias("draw"), F.col("r._id").alias(id_col), *[F.col(f"r.{c}").alias(c) for c in rest])


def _hash_position(df: DataFrame, label: str, id_col: str, seed: int) -> DataFrame:
    h = df.withColumn("_h", _digest(F.col(id_col), F.lit(seed)))
    return position_within(h, [label], ["_h", id_col], out="_pos").drop("_h")


def stratified_split(df: DataFrame, label: str, id_col: str, fractions: Sequence[float] = (0.8, 0.1, 0.1), names: Sequence[str] = ("train", "val", "test"), seed: int = 42) -> DataFrame:
    """Adds ``split``: inside each label, rows in hash order are cut at rounded
    cumulative fractions, so every label is split in the same proportions."""
    pos = _hash_position(df, label, id_col, seed)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    j = pos.join(sizes, label)  # one row per label
    cuts = []
    acc = 0.0
    for f in fractions[:-1]:
        acc += f
        cuts.append(F.round(F.col("_n") * F.lit(acc)))
    split = F.lit(names[-1])
    for name, cut in reversed(list(zip(names[:-1], cuts))):
        split = F.when(F.col("_pos") < cut, F.lit(name)).otherwise(split)
    return j.withColumn("split", split).drop("_pos", "_n")


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 10, seed: int = 42) -> DataFrame:
    """Adds ``fold`` in 0..k-1: round-robin over each label's rows in hash order, so
    fold sizes per label differ by at most one."""
    pos = _hash_position(df, label, id_col, seed)
    return pos.withColumn("fold", F.pmod(F.col("_pos"), F.lit(k)).cast("int")).drop("_pos")


def prefix_sums(df: DataFrame, order: str, value: str, out: str = "_cum", num_partitions: int | None = None) -> DataFrame:
    """Exclusive prefix sums of ``value`` in ``order`` (a unique column), without a
    single-partition window: range partitions, per-partition totals (a table of
    ``num_partitions`` rows) and a window inside each partition."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    checkpoint_dir(spark)
    r = (
        df.repartitionByRange(n, F.col(order))
        .withColumn("_pid", F.shiftright(F.monotonically_increasing_id(), _LOCAL_BITS))
        .checkpoint(eager=True)  # sampled range bounds must not differ between the two uses
    )
    tot = r.groupBy("_pid").agg(F.sum(value).alias("_t"))
    offs = tot.select("_pid", F.coalesce(F.sum("_t").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    w = Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = r.withColumn("_loc", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return local.join(F.broadcast(offs), "_pid").withColumn(out, F.col("_off") + F.col("_loc")).drop("_pid", "_loc", "_off")


def weighted_bootstrap(df: DataFrame, id_col: str, weight: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, id): ``n`` draws with replacement, P(row) = weight / total weight.

    Weights are taken to six decimals as whole numbers, so the intervals of the rows touch
    without gap or overlap and every draw falls into exactly one.  Draws meet intervals by an
    equi-join on buckets, of which there are as many as rows and draws together."""
    spark = df.sparkSession
    units = F.round(F.col(weight).cast("double") * _UNITS).cast("long")
    base = df.select(id_col, units.alias("_w")).filter(F.col("_w") > 0)
    cum = prefix_sums(base, id_col, "_w", "_lo").withColumn("_hi", F.col("_lo") + F.col("_w"))
    size = cum.agg(F.struct(F.max("_hi").alias("total"), F.count(F.lit(1)).alias("rows"))).scalar()
    width = F.ceil(F.col("_s.total") / (F.col("_s.rows") + F.lit(n)))
    bucket = lambda x: F.floor(x / F.col("_width")).cast("long")
    spans = cum.withColumn("_s", size).withColumn("_width", width)
    # each row is listed under every bucket its interval touches
    spans = spans.select(id_col, "_lo", "_hi", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi") - 1))).alias("_b"))
    draws = spark.range(n).select(F.col("id").alias("draw"), _uniform(F.col("id"), F.lit(seed)).alias("_u"))
    draws = draws.withColumn("_s", size).withColumn("_width", width)
    draws = draws.withColumn("_t", F.least(F.floor(F.col("_u") * F.col("_s.total")).cast("long"), F.col("_s.total") - 1))
    draws = draws.select("draw", "_t", bucket(F.col("_t")).alias("_b"))
    hit = draws.join(spans, "_b").filter((F.col("_t") >= F.col("_lo")) & (F.col("_t") < F.col("_hi")))
    return hit.select("draw", id_col)
