"""Approximate nearest neighbours by multi-index hashing.

Learning (bounded sample of ``SAMPLE`` vectors): several random orthonormal bases, each
turned by iterative quantisation, give 256 bits a vector; for inner products one dimension
is added that makes all norms equal.  The sample also gives the mean and spread of the
Hamming distance at a cosine, and with it each query its radius: that of the cosine which
its k-th neighbour is expected to have, plus ``DEVIATIONS`` deviations.

Search: a code is 32 substrings of a byte.  With radius r = 32 a + b, a code within r is
within a of the query in one of the first b + 1 substrings or within a - 1 in one of the
others (pigeonhole), so probing these buckets of all 32 substring indexes retrieves every code
within r.  The rows within n bits of a byte value are a bitmap, made from those within n - 1, so a probe
of a substring is one OR.  Codes beyond r are dropped by full distance and the rest is ranked by
the double product of the original vectors (of a whole block by one matrix product: the radius
of vectors without near neighbours lets most buckets through).  A query with fewer than k results is searched again without
a bound, so a short list means that there are no more candidates.

The table is dealt into blocks of ``BLOCK`` vectors, each indexed in memory, the query set into
chunks of ``CHUNK``; a task joins one block and one chunk and returns k rows a query.

Defined results: vectors that are null, zero, of another length than most, or that hold a
null or non-finite component take no part; equal scores go to the smaller id; rows that
repeat an id are separate vectors, and a query id that repeats is asked once, with its smallest
vector; an empty table or query set gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chorus.llm.common import cut

BITS = 256
PARTS = BITS // 8
SAMPLE = 4096
BLOCK, CHUNK = 8192, 2048
PAIRS = 1 << 16  # pairs that are compared one by one at a time
DEVIATIONS = 2.0


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part; v is array<double>."""
    v = F.col("v")
    flat = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        v.isNotNull() & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0.0)
    )
    width = flat.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    return flat.where(F.size(v) == (width["n"] if width else 0))


def matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class Codes:
    """Learned rotations and the relation between cosine and Hamming distance."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, largest: float, rows: int, k: int, seed: int = 7, rounds: int = 20):
        rng = np.random.default_rng(seed)
        self.largest, self.ids = largest, ids
        x = self.level(sample)
        d = x.shape[1]
        w = min(d, 64)
        self.turns = []
        for _ in range(-(-BITS // w)):
            basis = np.linalg.qr(rng.normal(size=(d, w)))[0]
            y = x @ basis
            turn = np.linalg.qr(rng.normal(size=(w, w)))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
                turn = (u @ vt).T
            self.turns.append(basis @ turn)
        self.sample = x / np.linalg.norm(x, axis=1, keepdims=True)
        # distance by cosine, from pairs of the sample
        code = self.encode(sample)
        some = slice(0, 512)
        dist = hamming(code[some], code).ravel()
        cos = np.clip((self.sample[some] @ self.sample.T).ravel(), -1, 1)
        share = np.arccos(cos) / np.pi * BITS
        self.scale = float((share * dist).sum() / max((share * share).sum(), 1e-9))
        # rank of the k-th neighbour among the sample, one further to be on the safe side
        self.rank = min(len(x) - 1, int(np.ceil(k * len(x) / max(rows, 1))) + 1)

    def level(self, v: np.ndarray) -> np.ndarray:
        """Vectors with one more dimension that makes all norms equal."""
        more = np.sqrt(np.maximum(self.largest - (v * v).sum(1), 0))
        return np.concatenate([v, more[:, None]], 1)

    def encode(self, v: np.ndarray) -> np.ndarray:
        """Bytes of the codes, (n, 32)."""
        return self._bits(self.level(v))

    def _bits(self, x: np.ndarray) -> np.ndarray:
        bits = np.concatenate([x @ t for t in self.turns], 1)[:, :BITS] >= 0
        return np.packbits(bits, axis=1)

    def encode_queries(self, v: np.ndarray) -> np.ndarray:
        return self._bits(np.concatenate([v, np.zeros((len(v), 1))], 1))

    def radius(self, v: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Hamming radius of each query."""
        q = np.concatenate([v / np.linalg.norm(v, axis=1, keepdims=True), np.zeros((len(v), 1))], 1)
        cos = q @ self.sample.T
        cos[ids[:, None] == self.ids[None, :]] = -1
        at = np.clip(-np.partition(-cos, self.rank, axis=1)[:, self.rank], -1, 1)
        p = np.clip(np.arccos(at) / np.pi * self.scale, 1e-3, 1 - 1e-3)
        return np.minimum(np.ceil(BITS * p + DEVIATIONS * np.sqrt(BITS * p * (1 - p))), BITS).astype(int)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    out = np.zeros((len(a), len(b)), np.uint16)
    words = np.ascontiguousarray(b.T)
    for at in range(0, len(a), 16):  # few rows at a time stay in the processor's cache
        for k, word in enumerate(words):
            out[at : at + 16] += np.bitwise_count(a[at : at + 16, k, None] ^ word)
    return out


class SubstringIndex:
    """The 32 substring indexes of one block: for each byte value, the rows that have it as a bitmap;
    ``ball(n)`` has the rows whose byte is within n bits of a value, made from ``ball(n - 1)``."""

    def __init__(self, code: np.ndarray):
        self.code = code
        here = np.zeros((PARTS, 256, -(-len(code) // 64) * 8), np.uint8)
        row = np.arange(len(code))
        for t in range(PARTS):
            np.bitwise_or.at(here[t], (code[:, t], row >> 3), (128 >> (row & 7)).astype(np.uint8))
        self.balls = [here.view(np.uint64)]

    def ball(self, reach: int) -> np.ndarray:
        while len(self.balls) <= reach:
            last = self.balls[-1]
            more, values = last.copy(), np.arange(256)
            for bit in range(8):
                more |= last[:, values ^ (1 << bit)]
            self.balls.append(more)
        return self.balls[reach]

    def retrieved(self, code: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(queries, rows) mask of the rows in the probed buckets."""
        seen = np.zeros((len(code), self.balls[0].shape[2]), np.uint64)
        a, b = np.minimum(radius, BITS) // PARTS, np.minimum(radius, BITS) % PARTS
        for t in range(PARTS):
            reach = np.where(t <= b, a, a - 1)
            for r in np.unique(reach[reach >= 0]):
                some = np.flatnonzero(reach == r)
                seen[some] |= self.ball(int(r))[t, code[some, t]]
        return np.unpackbits(seen.view(np.uint8), axis=1, count=len(self.code)).view(bool)

    def within(self, code: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(queries, rows) mask of the codes within each query's radius."""
        seen = self.retrieved(code, radius)
        if 8 * np.count_nonzero(seen) > seen.size:
            return seen & (hamming(code, self.code) <= radius[:, None])
        who, row = np.nonzero(seen)
        for at in range(0, len(who), PAIRS):
            i, j = who[at : at + PAIRS], row[at : at + PAIRS]
            seen[i, j] = np.bitwise_count(code[i].view(np.uint64) ^ self.code[j].view(np.uint64)).sum(1, dtype=int) <= radius[i]
        return seen


def best(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, mask: np.ndarray, k: int):
    """(queries, rows, scores) of the k largest products a query, ties to the smaller id."""
    mask = mask & (q_ids[:, None] != ids[None, :])
    far = np.where(mask, -q @ v.T, np.inf)
    last = min(k, len(v)) - 1
    least = np.partition(far, last, axis=1)[:, last]  # infinite: fewer than k, all are taken
    who, row = np.divmod(np.flatnonzero(mask & (far <= (least + 1e-9 * np.maximum(1.0, np.abs(least)))[:, None])), len(v))
    # the same order of sums wherever a vector stands
    score = np.concatenate([np.empty(0), *((v[row[x : x + PAIRS]] * q[who[x : x + PAIRS]]).sum(1) for x in range(0, len(who), PAIRS))])
    o = np.lexsort((ids[row], -score, who))
    who, row, score = who[o], row[o], score[o]
    top = np.arange(len(who)) - np.searchsorted(who, who) < k
    return who[top], row[top], score[top]


_OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def search(table: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): up to k nearest rows of ``table`` per query row, own id
    left out."""
    spark = table.sparkSession
    base = cut(usable(table, id_col, vec_col))
    asked = cut(usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    rows, largest = base.agg(F.count(F.lit(1)), F.max(norm)).first()
    wanted = asked.count()
    schema = "query_id long, vec_id long, score double"
    if not rows or not wanted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    codes = spark.sparkContext.broadcast(Codes(np.stack(drawn["v"].to_numpy()), drawn["id"].to_numpy(), largest, rows, k))
    blocks, chunks = -(-rows // BLOCK), -(-wanted // CHUNK)

    def run(bounded: bool):
        def task(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _OUT.empty_table()
            c, v, ids = codes.value, matrix(left.column("v")), left.column("id").to_numpy()
            index = SubstringIndex(c.encode(v))
            out: list[pa.Table] = []
            qv, qi = matrix(right.column("v")), right.column("id").to_numpy()
            for at in range(0, len(qi), 256):
                q, i = qv[at : at + 256], qi[at : at + 256]
                r = c.radius(q, i) if bounded else np.full(len(q), BITS)
                mask = index.within(c.encode_queries(q), r)
                a, b, score = best(q, i, v, ids, mask, k)
                out.append(pa.Table.from_arrays([pa.array(x) for x in (i[a], ids[b], score)], schema=_OUT))
            return pa.concat_tables(out)

        return task

    def pass_over(q: DataFrame, bounded: bool) -> DataFrame:
        deal = lambda df, n: F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n))
        left = base.withColumn("b", deal(base, blocks)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        right = q.withColumn("c", deal(q, chunks)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        left, right = (d.select(F.col("b").cast("long"), F.col("c").cast("long"), "id", "v") for d in (left, right))
        found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(run(bounded), schema)
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)

    first = cut(pass_over(asked, True))
    short = first.groupBy("query_id").agg(F.max("rank").alias("n")).where(F.col("n") >= k)
    again = asked.join(short, F.col("id") == F.col("query_id"), "left_anti")
    if again.isEmpty():
        out = first
    else:
        again = cut(again)
        done = first.join(again.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti")
        out = done.unionByName(cut(pass_over(again, False)))
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
