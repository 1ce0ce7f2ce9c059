"""Inter-annotator agreement (Cohen's kappa per rater pair and its mean).

Raters are columns of a wide table, so rater pairs are pairs of *columns* known from
the schema.  Observed agreement is one aggregation over the wide table (a sum per
pair); expected agreement comes from per-(rater, label) counts, a table bounded by
raters x labels.  No row of the data is ever paired with another row.
A missing rating counts as the label ``nan``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "nan"


def kappa_pairwise(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """(coder_a, coder_b, ao, ae, kappa) for every unordered rater pair (a < b)."""
    r = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in raters}
    pairs = list(combinations(sorted(raters), 2))
    agree = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum((r[a] == r[b]).cast("long")).alias(f"_ag{i}") for i, (a, b) in enumerate(pairs)],
    )
    stack_pairs = ", ".join(f"'{a}', '{b}', _ag{i}" for i, (a, b) in enumerate(pairs))
    ao = agree.selectExpr("_n", f"stack({len(pairs)}, {stack_pairs}) as (coder_a, coder_b, _agree)")
    stack_r = ", ".join(f"'{c}', coalesce(cast(`{c}` as string), '{MISSING}')" for c in raters)
    long = df.selectExpr(f"stack({len(raters)}, {stack_r}) as (coder, label)")
    freq = long.groupBy("coder", "label").agg(F.count(F.lit(1)).alias("_c"))  # raters x labels rows
    fa = freq.select(F.col("coder").alias("coder_a"), "label", F.col("_c").alias("_ca"))
    fb = freq.select(F.col("coder").alias("coder_b"), "label", F.col("_c").alias("_cb"))
    ae_terms = fa.join(fb, "label").filter(F.col("coder_a") < F.col("coder_b"))
    ae = ae_terms.groupBy("coder_a", "coder_b").agg(F.sum(F.col("_ca") * F.col("_cb")).alias("_prod"))
    j = ao.join(ae, ["coder_a", "coder_b"], "left")
    ao_c = F.col("_agree") / F.col("_n")
    ae_c = F.coalesce(F.col("_prod"), F.lit(0)) / (F.col("_n") * F.col("_n"))
    return j.select(
        "coder_a", "coder_b", ao_c.alias("ao"), ae_c.alias("ae"), F.try_divide(ao_c - ae_c, F.lit(1.0) - ae_c).alias("kappa")
    )


def kappa_mean(df: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Multi-rater kappa: the mean of the pairwise values."""
    return kappa_pairwise(df, raters).agg(F.avg("kappa").alias("kappa"), F.count(F.lit(1)).alias("pairs"))
