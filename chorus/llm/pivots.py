"""Embedding near-duplicates by a pivot-permutation index.

Pivots are ``PIVOTS`` reference vectors, chosen far apart from a bounded sample of
``SAMPLE``.  A vector is described by the order of its ``DEPTH`` nearest pivots and posted in
the inverted lists of those pivots.  A pair is a candidate if it shares ``SHARED`` of them;
instead of merging whole pivot lists, lists are kept by combination of ``SHARED`` pivots, which
holds exactly the vectors that share these.  A pair that shares more meets in several lists
and counts in the one of its smallest shared combination only.  Candidates are verified by
cosine in double precision.

Equal vectors are one class first, so a vector that fills a third of the table is one row with
a size.  Lists are cut into blocks of ``CHUNK`` classes; a task compares two blocks as
matrices and returns link counts and a spanning set of links, never the pairs.

Defined results: vectors that are null, zero, of another length than most, or that hold a
null or non-finite component have no links and are their own component; a null vec_id has a
null component and is kept; rows that repeat a vec_id are separate vectors under one id, and
equal vectors are linked with each other whatever their ids.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import batch, by_group, cut, own
from chorus.llm.mih import matrix, usable
from chorus.operators.graph import connected_components

PIVOTS, DEPTH, SHARED = 256, 8, 4
SAMPLE = 4096
CHUNK = 256
APART = 0.7


def far_apart(sample: np.ndarray, n: int, most: float = APART) -> np.ndarray:
    """Up to n unit vectors of the sample, each as far as can be from those before and no
    nearer than cosine ``most``: inside a dense group, references would order at random."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(n, len(x)):
        if near.min() >= most:
            break
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


_POST = pa.schema([("cid", pa.int64()), ("size", pa.int64()), ("v", pa.list_(pa.float64())), ("mask", pa.binary()), ("keys", pa.list_(pa.int64()))])


def _describe(pivots, depth: int, shared: int):
    def run(batches):
        p = pivots.value
        pick = np.array(list(combinations(range(min(depth, len(p))), min(shared, depth, len(p)))))
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(b.column("v"))
            sim = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ p.T
            order = np.argsort(-sim, axis=1, kind="stable")[:, :depth]  # the permutation's head
            head = np.sort(order, axis=1)
            key = np.zeros((len(v), len(pick)), np.int64)
            for k in range(pick.shape[1]):
                key = key * PIVOTS + head[:, pick[:, k]]
            bits = np.zeros((len(v), PIVOTS), bool)
            np.put_along_axis(bits, head, True, axis=1)
            mask = np.packbits(bits, axis=1)
            keys = pa.ListArray.from_arrays(np.arange(0, key.size + 1, key.shape[1], dtype=np.int32), key.ravel())
            yield pa.RecordBatch.from_arrays(
                [b.column("cid"), b.column("size"), b.column("v"), pa.array([m.tobytes() for m in mask], pa.binary()), keys], names=_POST.names
            )

    return run


_LINK = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def _verify(least: float, shared: int):
    def run(table: pa.Table):
        key, i, j = (table.column(n)[0].as_py() for n in ("key", "i", "j"))
        last = key % PIVOTS  # the largest pivot of the combination
        cid, size, at = (table.column(n).to_numpy() for n in ("cid", "size", "c"))
        v = matrix(table.column("v"))
        v = v / np.linalg.norm(v, axis=1, keepdims=True)
        mask = np.frombuffer(b"".join(table.column("mask").to_pylist()), np.uint64).reshape(len(v), -1)
        upto = np.packbits(np.arange(PIVOTS) <= last).view(np.uint64)
        x, y = np.flatnonzero(at == i), np.flatnonzero(at == j)
        linked = v[x] @ v[y].T >= least
        both = np.zeros(linked.shape, np.uint8)
        for k in range(mask.shape[1]):
            both += np.bitwise_count(mask[x, k][:, None] & mask[y, k][None, :] & upto[k])
        linked &= both == shared
        if i == j:
            linked &= cid[x][:, None] != cid[y][None, :]
        if not linked.any():
            return
        links = np.zeros(len(v), np.int64)
        links[x] += linked @ size[y]
        if i != j:
            links[y] += linked.T @ size[x]
        label = np.arange(len(v))
        while True:  # smallest row of each part
            new = label.copy()
            new[x] = np.minimum(new[x], np.where(linked, label[y][None, :], len(v)).min(1))
            new[y] = np.minimum(new[y], np.where(linked, new[x][:, None], len(v)).min(0))
            new = new[new]
            if (new == label).all():
                break
            label = new
        rows = np.flatnonzero(links)
        yield batch(_LINK, cid=cid[rows], links=links[rows], to=cid[label[rows]])

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = 0.95,
                    depth: int = DEPTH, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    spark = vectors.sparkSession
    hashes = lambda v: (F.xxhash64(v).alias("h1"), F.xxhash64(F.lit(1), v).alias("h2"))
    good = cut(usable(vectors, id_col, vec_col).where("id IS NOT NULL").select("id", "v", *hashes("v")))
    classes = cut(good.groupBy("h1", "h2").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("size"), F.first("v").alias("v")))
    drawn = classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("v").toPandas()
    ids = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    if drawn.empty:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pivots = far_apart(np.stack(drawn["v"].to_numpy()), PIVOTS)
    shared = min(shared, depth, len(pivots))
    posts = cut(classes.mapInArrow(
        _describe(spark.sparkContext.broadcast(pivots), depth, shared),
        "cid long, size long, v array<double>, mask binary, keys array<long>",
    ))
    posting = posts.select("cid", F.explode("keys").alias("key"))
    lists = posting.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = lists.select(own("key").alias("k"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    meet = posting.join(lists, F.col("key") == F.col("k")).withColumn("c", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    meet = meet.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", F.col("cid").alias("who")
    )
    rows = meet.join(posts.select("cid", "size", "v", "mask"), F.col("who") == F.col("cid")).drop("who")
    found = cut(by_group(rows, ["key", "i", "j"], _verify(least, shared), "cid long, links long, to long"))

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select("cid", "to"), "cid", "to")
    per = (
        classes.select("h1", "h2", F.col("cid").alias("me"), "size")
        .join(links.select(own("cid").alias("a"), "links"), F.col("me") == F.col("a"), "left")
        .join(comp.select(own("node").alias("b"), "component"), F.col("me") == F.col("b"), "left")
        .select(own("h1").alias("g1"), own("h2").alias("g2"),
                (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "me").alias("component"))
    )
    v = F.col(vec_col).cast("array<double>")
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), *hashes(v))
    out = every.join(per, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & F.col("vec_id").isNotNull(), "left")
    comp_id = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"),
    )


def lists_per_vector(depth: int = DEPTH, shared: int = SHARED) -> int:
    return comb(depth, shared)
