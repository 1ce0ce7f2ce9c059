"""Projections, filters, joins and set operations.

No join is forced to broadcast but that of ``min_activity`` with a counted short list: adaptive execution knows the bytes of a finished side and
converts the join when they are below ``spark.sql.autoBroadcastJoinThreshold``.  Anti joins are ``left_anti`` (null keys of the left side
are kept, as pandas ``~isin`` keeps them), never ``NOT IN``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.session import checkpoint_dir

FEW_KEYS = 100_000  # keys that a task may hold


# --- P1 / P2 / P3 ------------------------------------------------------------
def project_rename(df: DataFrame, keep: Sequence[str], rename: Mapping[str, str] | None = None, constants: Mapping[str, object] | None = None) -> DataFrame:
    out = df.select(*keep)
    for old, new in (rename or {}).items():
        out = out.withColumnRenamed(old, new)
    for name, value in (constants or {}).items():
        out = out.withColumn(name, F.lit(value))
    return out


def recode(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Exact value replacement; values not in the map stay as they are."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(column, F.coalesce(F.element_at(m, F.col(column)), F.col(column)))


# --- P4 / P5 / P6 ------------------------------------------------------------
def filter_equal(df: DataFrame, column: str, value: object, enabled: bool = True) -> DataFrame:
    """``column == value``; nulls drop.  ``enabled=False`` returns the input."""
    return df.filter(F.col(column) == F.lit(value)) if enabled else df


def filter_range(df: DataFrame, column: Column | str, lower: float | None = None, upper: float | None = None) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    cond = F.lit(True)
    if lower is not None:
        cond = cond & (c >= lower)
    if upper is not None:
        cond = cond & (c <= upper)
    return df.filter(cond)


def short_texts(df: DataFrame, text: str, below: int) -> DataFrame:
    return df.filter(F.length(text) < below).select(text).distinct()


# --- P7 ----------------------------------------------------------------------
def min_activity(df: DataFrame, key: str, id_col: str, min_count: int) -> DataFrame:
    """Drop every row of keys with fewer than ``min_count`` non-null ids; null keys stay.

    The per-key counts are a partial (map-side) aggregation; the drop list is applied
    with a left anti join so that null keys survive.  Up to ``FEW_KEYS`` keys the list goes to every
    task, so that the rows stay where they are: dealt by key, the rows of a hot one are one task.
    """
    counts = df.groupBy(key).agg(F.count(id_col).alias("_n"))
    drop = counts.filter((F.col("_n") < min_count) & F.col(key).isNotNull()).select(key)
    checkpoint_dir(df.sparkSession)
    drop = drop.checkpoint()
    return df.join(F.broadcast(drop) if drop.count() <= FEW_KEYS else drop, on=key, how="left_anti")


# --- P9 ----------------------------------------------------------------------
def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: (column, nulls) - a single pass with one count_if per column."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {stack}) as (`column`, nulls)")


# --- J1-J5 -------------------------------------------------------------------
def join_lower_key(facts: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, how: str = "inner") -> DataFrame:
    """Equi join on lower-cased keys."""
    d = dim.withColumn("_k", F.lower(F.col(dim_key))).drop(dim_key)
    f = facts.withColumn("_k", F.lower(F.col(fact_key)))
    return f.join(d, "_k", how).drop("_k")


def join_with_suffixes(left: DataFrame, right: DataFrame, on: str, how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Equi join on ``on``; columns present on both sides get pandas-style suffixes."""
    clash = (set(left.columns) & set(right.columns)) - {on}
    l2 = left.select(*[F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in left.columns])
    r2 = right.select(*[F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c) for c in right.columns])
    return l2.join(r2, on, how)


def semi_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


# --- U1-U3 -------------------------------------------------------------------
def weighted_union(frames: Iterable[tuple[DataFrame, float]], weight_col: str = "weight") -> DataFrame:
    out = None
    for df, w in frames:
        part = df.withColumn(weight_col, F.lit(w).cast("double"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dedup_on(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep one row per distinct value of ``columns`` - the one with the smallest
    remaining columns, so the result does not depend on partitioning."""
    rest = [c for c in df.columns if c not in columns]
    if not rest:
        return df.select(*columns).distinct()
    picked = df.groupBy(*columns).agg(F.min(F.struct(*rest)).alias("_r"))
    return picked.select(*columns, *[F.col(f"_r.{c}").alias(c) for c in rest])


def union_distinct(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out.distinct()
