"""Connected components by alternating large-star and small-star passes.

Every round is two aggregations and two equi-joins over the edge table; the number of
rounds grows with the logarithm of the longest path, there is no round limit, and a
node with very many edges is only ever the key of a partial minimum or of a join that
adaptive execution can split.  Lineage is cut each round by a table in the shared folder:
unlike a checkpoint, which keeps the planner's size estimate, a table has its real size.  The
estimate of a join is a product of sizes, so over many rounds it would grow to millions of digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.session import scratch_path


def _star_min(pairs: DataFrame) -> DataFrame:
    """(key, v) -> the smallest v of each key.  The key is re-expressed so that the later
    join gets an exchange of its own (a skewed join is only split between two exchanges;
    adding 0 would be simplified away)."""
    m = pairs.groupBy("key").agg(F.min("v").alias("m"))
    return m.select(F.col("key").bitwiseXOR(F.lit(0)).alias("k"), "m")


def _stored(edges: DataFrame) -> DataFrame:
    path = scratch_path(edges.sparkSession, "edges")
    edges.write.parquet(path)
    return edges.sparkSession.read.schema("hi long, lo long").parquet(path)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of ``edges`` (integer ids); ``component`` is the
    smallest id that the node reaches.  Edges with a null end and self-loops add nothing."""
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    e = _stored(
        edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
        .where(a.isNotNull() & b.isNotNull() & (F.col("hi") != F.col("lo")))
        .distinct()
    )
    while True:
        sym = e.select(F.col("hi").alias("key"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("key"), F.col("hi").alias("v"))
        )
        m = _star_min(sym)
        large = (
            sym.where(F.col("v") > F.col("key"))
            .join(m, F.col("key") == F.col("k"))
            .select(F.col("v").alias("hi"), F.least("key", "m").alias("lo"))
            .distinct()
        )
        pairs = large.select(F.col("hi").alias("key"), F.col("lo").alias("v"))
        m = _star_min(pairs)
        both = pairs.join(m, F.col("key") == F.col("k")).select("key", "v", "m")
        e = _stored(
            both.select(F.explode(F.array("key", "v")).alias("hi"), F.col("m").alias("lo"))
            .where(F.col("hi") != F.col("lo"))
            .distinct()
        )
        # done when no node is both a child and a parent, and each child has one parent
        ends = e.select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.lit(1).alias("up")),
                                          F.struct(F.col("lo").alias("node"), F.lit(0).alias("up")))).alias("x"))
        open_nodes = (
            ends.groupBy("x.node").agg(F.sum("x.up").alias("up"), F.min("x.up").alias("parent"))
            .where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("parent") == 0)))
        )
        if open_nodes.isEmpty():
            break
    return (
        e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        .unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
    )
