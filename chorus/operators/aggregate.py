"""Grouped and global aggregates.

All of these are hash aggregations with map-side partial aggregation, so a hot key
only costs one partial row per map task.  Exact quantiles (linear interpolation, the pandas
definition) come from value counts and prefix sums, so no group sits in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- A1 ------------------------------------------------------------------------
def count_by_key(df: DataFrame, key: str, id_col: str, out: str = "n") -> DataFrame:
    """Non-null ids per key; null keys are dropped like a pandas groupby."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(id_col).alias(out))


# --- A2 ------------------------------------------------------------------------
def value_counts(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """Counts per non-null value; sort with ``orderBy(desc(out), column)`` at the sink."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(out))


# --- A3 ------------------------------------------------------------------------
def class_ratio(df: DataFrame, column: str, value: object, percent: bool = True) -> DataFrame:
    """Share of rows equal to ``value`` among non-null values."""
    share = F.avg((F.col(column) == F.lit(value)).cast("double"))
    return df.agg((share * (100.0 if percent else 1.0)).alias("ratio"))


# --- A9 ------------------------------------------------------------------------
def group_max(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.max(c).alias(c) for c in columns])


# --- A11 -----------------------------------------------------------------------
def length_stats(df: DataFrame, text: str) -> DataFrame:
    n = F.length(text)
    return df.agg(F.max(n).cast("long").alias("max_len"), F.avg(n).alias("mean_len"))


# --- A12 -----------------------------------------------------------------------
def describe(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std (n-1), min, quartiles (linear interpolation), max."""
    x = F.col("_x")
    one = df.select(F.lit(0).alias("_all"), F.col(column).cast("double").alias("_x"))
    plain = one.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    quartiles = exact_quantiles(one, ["_all"], "_x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    plain = plain.withColumn("_q", quartiles.select(F.struct("q25", "q50", "q75")).scalar())
    return plain.select("count", "mean", "std", "min", "_q.q25", "_q.q50", "_q.q75", "max")


# --- A13 -----------------------------------------------------------------------
def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_distinct) for each column, non-null values only."""
    wide = df.agg(*[F.count_distinct(c).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return wide.selectExpr(f"stack({len(columns)}, {stack}) as (`column`, n_distinct)")


# --- A15 -----------------------------------------------------------------------
def _value_counts(df: DataFrame, column: Column | str) -> DataFrame:
    """(x, c): ONE pass over the data.  The bin bounds (a scalar subquery) and the bins
    are both computed from this pre-aggregate - at most one row per distinct value -
    which is checkpointed to the shared folder so the input (and any expensive
    expression in ``column``) is not evaluated a second time for the subquery."""
    from chorus.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    x = _c(column).cast("double")
    vals = df.select(x.alias("_x")).groupBy("_x").agg(F.count(F.lit(1)).alias("_c")).checkpoint(eager=True)
    return vals.filter(F.col("_x").isNotNull())


def hist_fixed_width(df: DataFrame, column: Column | str, width: float, out: str = "n") -> DataFrame:
    """Bins of fixed width starting at the minimum: bin = floor((x - min) / width).
    The minimum is a scalar subquery, not a join."""
    vals = _value_counts(df, column)
    vals = vals.withColumn("_lo", vals.agg(F.min("_x")).scalar())  # one subquery, projected once
    b = F.floor((F.col("_x") - F.col("_lo")) / F.lit(float(width))).cast("long")
    return (
        vals.groupBy(b.alias("bin"), F.col("_lo"))
        .agg(F.sum("_c").cast("long").alias(out))
        .select("bin", (F.col("_lo") + F.col("bin") * F.lit(float(width))).alias("lo"), out)
    )


# --- A16 -----------------------------------------------------------------------
def hist_fixed_bins(df: DataFrame, column: Column | str, bins: int, out: str = "n") -> DataFrame:
    """``bins`` equal bins over [min, max]; the last bin is closed on the right."""
    vals = _value_counts(df, column)
    vals = vals.withColumn("_r", vals.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar())
    lo, hi = F.col("_r.lo"), F.col("_r.hi")
    w = (hi - lo) / F.lit(float(bins))
    b = F.when(w == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("_x") - lo) / w), F.lit(bins - 1))).cast("long")
    return vals.groupBy(b.alias("bin")).agg(F.sum("_c").cast("long").alias(out))


# --- A17 -----------------------------------------------------------------------
def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """(keys..., name...) exact quantiles with linear interpolation (the pandas / SQL
    ``quantile_cont`` definition) without holding a group in one task.

    Equal values are counted first, so a value that fills a third of a key is one row; the
    number of rows up to each distinct value is a skew-safe prefix sum
    (:func:`chorus.operators.ranking.prefix_within`).  The two ranks a quantile needs
    (q * (n - 1) rounded down and up) are looked up in these intervals.  Keys must be non-null.
    """
    from chorus.operators.ranking import prefix_within

    x = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    counts = x.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = prefix_within(counts, list(keys), ["_v"], "_c", how="sum", out="_end")
    n = upto.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    qs = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("_n") - 1)).alias("h")) for name, q in quantiles.items()])
    need = n.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], qs.alias("_q"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    lo, hi = lambda q: F.floor(q["h"]), lambda q: F.ceil(q["h"])
    inside = lambda r: (r >= F.col("_end") - F.col("_c")) & (r < F.col("_end"))
    hits = F.filter("_q", lambda q: inside(lo(q)) | inside(hi(q)))
    got = upto.join(need, same).withColumn("_q", hits).where(F.size("_q") > 0)  # few rows a key are left
    ends = got.select(*keys, "_v", F.inline("_q")).groupBy(*keys, "name", "h").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"))
    res = ends.select(*keys, "name", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("h") - F.floor("h"))).alias("_x"))
    return res.groupBy(*keys).pivot("name", list(quantiles)).agg(F.first("_x"))


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """min, quartiles (exact, interpolated) and max per key; the quartiles come from
    :func:`exact_quantiles`, so a hot key is not gathered into one task."""
    x = F.col(value).cast("double")
    ends = df.groupBy(*keys).agg(F.min(x).alias("min"), F.max(x).alias("max"))
    qs = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return ends.join(qs, list(keys)).select(*keys, "min", "q1", "median", "q3", "max")


# --- A18 -----------------------------------------------------------------------
def run_average(df: DataFrame, params: Sequence[str], scores: Sequence[str]) -> DataFrame:
    return df.groupBy(*params).agg(*[F.avg(s).alias(f"mean_{s}") for s in scores], F.count(F.lit(1)).alias("runs"))


# --- S5 ------------------------------------------------------------------------
def best_config(df: DataFrame, group: Sequence[str], params: Sequence[str], score: str) -> DataFrame:
    """Per group, the parameter row with the highest score (ties: smallest params).

    One aggregation: ``max`` over ``struct(score, -rank)`` is not expressible for
    strings, so take the best score first and the smallest params among its rows.
    """
    best = df.groupBy(*group).agg(F.max(F.col(score)).alias("_best"))
    cand = df.join(best, list(group)).filter(F.col(score) == F.col("_best"))
    pick = cand.groupBy(*group).agg(F.min(F.struct(*[F.col(p) for p in params])).alias("_p"), F.max("_best").alias(score))
    return pick.select(*group, *[F.col(f"_p.{p}").alias(p) for p in params], score)
