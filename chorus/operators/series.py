"""Metric histories: consecutive deltas, early stopping and run keep-filters.

A history is one row per (run, epoch).  Deltas use an equi self-join on
(run, epoch) = (run, epoch - 1), which hash-partitions on both columns, so a long run
is spread over many tasks; the per-run sum of deltas telescopes to last - first and
is a partial aggregation (``max_by`` / ``min_by``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.operators.ranking import prefix_within


def series_delta(df: DataFrame, run: str, epoch: str, value: str) -> DataFrame:
    """(run, epoch, delta) for every epoch that has a predecessor."""
    prev = df.select(F.col(run), (F.col(epoch) + 1).alias(epoch), F.col(value).alias("_prev"))
    return df.join(prev, [run, epoch]).select(run, epoch, (F.col(value) - F.col("_prev")).alias("delta"))


def delta_sum(df: DataFrame, run: str, epoch: str, value: str) -> DataFrame:
    """(run, delta_sum) = sum of consecutive deltas = last value - first value."""
    return df.groupBy(run).agg((F.max_by(value, epoch) - F.min_by(value, epoch)).alias("delta_sum"))


def early_stop(df: DataFrame, run: str, epoch: str, value: str, patience: int = 10, mode: str = "max", min_delta: float = 0.0, percentage: bool = False) -> DataFrame:
    """(run, stop_epoch, best_epoch, best_value, epochs): early stopping replayed on a
    finished history.

    Epoch 1 sets the best.  A later epoch improves when it beats the best by more than
    ``min_delta`` (absolute, or percent of the best); otherwise the bad-epoch counter
    grows, and the run stops at the first epoch where it reaches ``patience``.  A NaN
    value never improves and stops at once; ``patience = 0`` never stops on bad epochs.
    ``stop_epoch`` is null when the run never stops, ``best_epoch`` when every value was NaN.

    With ``min_delta == 0`` the best so far is a running max/min and the last
    improvement a running max, both computed by skew-safe prefix scans
    (:func:`chorus.operators.ranking.prefix_within`).  With ``min_delta > 0`` the best
    depends on the path and is folded with ``aggregate`` over the run's ordered values;
    that group is one training history, bounded by the epoch budget.
    """
    if mode not in ("min", "max"):
        raise ValueError(f"expected mode min or max, got {mode!r}")
    if min_delta == 0.0:
        # running best and last improvement as skew-safe prefix scans (a long run is
        # split over many tasks); "min" mode scans the negated value
        base = df.select(run, epoch, value).withColumn(
            "_s", F.when(~F.isnan(F.col(value)), F.col(value) if mode == "max" else -F.col(value))
        )
        h = prefix_within(base, [run], [epoch], "_s", how="max", inclusive=False, out="_best_prev", keep_pieces=True)
        h = h.withColumn("_imp", F.when((F.col("_s").isNotNull() & F.col("_best_prev").isNull()) | (F.col("_s") > F.col("_best_prev")), F.col(epoch)))
        h = prefix_within(h, [run], [epoch], "_imp", how="max", inclusive=True, out="_last")
        h = h.withColumn("_stop", F.isnan(F.col(value)) | (F.lit(patience > 0) & ((F.col(epoch) - F.col("_last")) >= patience)))
        stops = h.groupBy(run).agg(
            F.min(F.when(F.col("_stop"), F.col(epoch))).alias("stop_epoch"),
            F.max(epoch).alias("_maxe"),
        )
        j = h.join(stops, run).filter(F.col(epoch) == F.coalesce(F.col("stop_epoch"), F.col("_maxe")))
        best = h.select(run, F.col(epoch).alias("best_epoch"), F.col(value).alias("best_value"))
        return j.select(run, "stop_epoch", F.col("_last").alias("best_epoch"), F.col(epoch).alias("epochs")).join(best, [run, "best_epoch"], "left").select(
            run, "stop_epoch", "best_epoch", "best_value", "epochs"
        )
    # path-dependent best: fold the ordered history of each run
    hist = df.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(value).alias("v")))).alias("h"))
    init = F.struct(
        F.lit(None).cast("double").alias("best"), F.lit(None).cast("long").alias("best_e"), F.lit(0).cast("long").alias("bad"),
        F.lit(None).cast("long").alias("stop"), F.lit(0).cast("long").alias("last_e"),
    )

    def step(acc, x):
        md = F.lit(min_delta) if not percentage else acc["best"] * F.lit(min_delta / 100.0)
        better = (x["v"] > acc["best"] + md) if mode == "max" else (x["v"] < acc["best"] - md)
        done = acc["stop"].isNotNull()
        first = acc["best"].isNull()
        bad = F.when(first | better, F.lit(0).cast("long")).otherwise(acc["bad"] + 1)
        stop_now = F.isnan(x["v"]) | (~first & F.lit(patience > 0) & (bad >= patience))
        return F.when(done, acc).otherwise(
            F.struct(
                F.when((first | better) & ~F.isnan(x["v"]), x["v"]).otherwise(acc["best"]).alias("best"),
                F.when((first | better) & ~F.isnan(x["v"]), x["e"].cast("long")).otherwise(acc["best_e"]).alias("best_e"),
                bad.alias("bad"),
                F.when(stop_now, x["e"].cast("long")).otherwise(F.lit(None).cast("long")).alias("stop"),
                x["e"].cast("long").alias("last_e"),
            )
        )

    r = hist.select(run, F.aggregate("h", init, step).alias("r"))
    return r.select(run, F.col("r.stop").alias("stop_epoch"), F.col("r.best_e").alias("best_epoch"), F.col("r.best").alias("best_value"), F.col("r.last_e").alias("epochs"))


def run_filter(df: DataFrame, run: str, epoch: str, value: str, min_last: float | None = None, min_max: float | None = None) -> DataFrame:
    """Rows of the runs whose last value >= ``min_last`` and whose max >= ``min_max``."""
    stats = df.groupBy(run).agg(F.max_by(value, epoch).alias("_last"), F.max(value).alias("_max"))
    cond = F.lit(True)
    if min_last is not None:
        cond = cond & (F.col("_last") >= min_last)
    if min_max is not None:
        cond = cond & (F.col("_max") >= min_max)
    return df.join(stats.filter(cond).select(run), run, "left_semi")
