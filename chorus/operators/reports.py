"""Per-dimension share reports (labels, topics) and their nested export.

The reference loops a full scan per key and per dimension; here each report is one
aggregation: rows are pre-aggregated at the finest key, then widened with
``GROUPING SETS`` so the Expand only multiplies the small pre-aggregate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _grouping_sets(df: DataFrame, dims: Sequence[str], item: str, value: str) -> DataFrame:
    """(dim, key, item, total) for each dimension in ``dims`` from a pre-aggregate."""
    sets = [[d, item] for d in dims]
    g = df.groupingSets(sets, *dims, item).agg(F.sum(value).alias("total"), F.grouping_id().alias("_g"))
    n = len(dims)
    dim_col = F.lit(None).cast("string")
    key_col = F.lit(None).cast("string")
    for i, d in enumerate(dims):
        gid = ((1 << n) - 1 - (1 << (n - 1 - i))) << 1
        dim_col = F.when(F.col("_g") == gid, F.lit(d)).otherwise(dim_col)
        key_col = F.when(F.col("_g") == gid, F.col(d).cast("string")).otherwise(key_col)
    return g.select(dim_col.alias("dim"), key_col.alias("key"), F.col(item), "total").filter(F.col("key").isNotNull())


def label_share_by_dim(df: DataFrame, dims: Sequence[str], label: str, labels: Sequence[str]) -> DataFrame:
    """(dim, key, label, share): count(label) / count(all non-null labels of the key),
    zero-filled over the fixed ``labels``; labels outside the list stay in the
    denominator.  Null keys are excluded."""
    pre = df.filter(F.col(label).isNotNull()).groupBy(*dims, label).agg(F.count(F.lit(1)).alias("_n"))
    g = _grouping_sets(pre, dims, label, "_n")
    totals = g.groupBy("dim", "key").agg(F.sum("total").alias("_all"))
    hits = g.filter(F.col(label).isin(*labels))
    grid = totals.select("dim", "key", "_all", F.explode(F.array(*[F.lit(x) for x in labels])).alias(label))
    return grid.join(hits, ["dim", "key", label], "left").select(
        "dim", "key", label, (F.coalesce(F.col("total"), F.lit(0)) / F.col("_all")).alias("share")
    )


def topic_share_by_dim(df: DataFrame, dims: Sequence[str], dist: str) -> DataFrame:
    """(dim, key, topic, share): summed topic probabilities of the key / their total."""
    ex = df.select(*dims, F.posexplode(dist).alias("topic", "_p"))
    pre = ex.groupBy(*dims, "topic").agg(F.sum("_p").alias("_s"))
    g = _grouping_sets(pre, dims, "topic", "_s")
    w = Window.partitionBy("dim", "key")  # one group = the topics of one key (bounded by k)
    return g.select("dim", "key", F.col("topic").cast("long").alias("topic"), (F.col("total") / F.sum("total").over(w)).alias("share"))


def topic_share_total(df: DataFrame, dist: str) -> DataFrame:
    """(topic, share): column sums of the distribution matrix over the grand sum."""
    sums = df.select(F.posexplode(dist).alias("topic", "_p")).groupBy("topic").agg(F.sum("_p").alias("_s"))
    grand = sums.agg(F.sum("_s")).scalar()
    return sums.select(F.col("topic").cast("long").alias("topic"), (F.col("_s") / grand).alias("share"))


def nested_report(df: DataFrame, dim: str, key: str, text: str, value: str) -> DataFrame:
    """(dim, key, items): items = list of {text, value} sorted by value desc, text asc.

    Each list holds the rows of one (dim, key), which come from bounded reports
    (a capped vocabulary, a fixed label list or k topics).
    """
    items = F.collect_list(F.struct((-F.col(value)).alias("_o"), F.col(text).alias("text"), F.col(value).alias("value")))
    return df.groupBy(dim, key).agg(
        F.transform(F.array_sort(items), lambda s: F.struct(s["text"].alias("text"), s["value"].alias("value"))).alias("items")
    )
