"""Vector code compression: product codes whose nearest entry is found by equal-average search.

Components become integers floor(scale * x) and a vector is cut into equal consecutive parts,
each with a codebook of its own.  The entries of a codebook are kept sorted by component sum.
The search starts at a part's own sum and expands outward; a side ends as soon as the squared
sum gap, divided by the part's dimension, strictly exceeds the best squared distance so far
(by Cauchy-Schwarz no entry beyond can be nearer, and an equally near one is still looked at).
So the result is exactly the nearest entry, ties to the lower index.

Training is Lloyd's iteration as Spark jobs: a task sums the parts of its rows per entry, the
partial sums meet in one aggregation, and only the codebooks (entries x dimension integers,
whatever the number of rows) reach the driver.

Defined results: rows whose vector is null, holds a null or non-finite component, or is not as
long as the vector of the smallest id (a table has one dimension) are dropped; a dimension that
the number of parts does not divide is an error.  Rows that repeat an id are coded one by one
(the first entries take equal ids in order of their vectors); null ids come last.  With fewer
rows than entries the codebooks are that small.  Scaled components are held within
+-2^30 / part dimension, so that all arithmetic is exact in 64 bits.  An empty table gives no
rows.  Labels may be null (one group); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import cut

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2


@dataclass(frozen=True)
class EqualAverage:
    """A codebook sorted by component sum."""

    book: np.ndarray  # entries x dimension, by index
    order: np.ndarray
    sums: np.ndarray

    @staticmethod
    def of(book: np.ndarray) -> EqualAverage:
        s = book.sum(axis=1)
        order = np.argsort(s, kind="stable")
        return EqualAverage(book, order, s[order])

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry and its squared distance for each part; the number of
        distances that were computed."""
        n, dim = parts.shape
        best, code = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.book))
        s = parts.sum(axis=1)
        at = np.searchsorted(self.sums, s)
        sides = [(np.arange(n), at, 1), (np.arange(n), at - 1, -1)]
        computed = 0
        while sides:
            held = []
            for rows, j, step in sides:
                inside = (j >= 0) & (j < len(self.order))
                rows, j = rows[inside], j[inside]
                gap = self.sums[j] - s[rows]
                # a side ends where gap^2 / dim > best; nothing ends while nothing has been found
                inside = (best[rows] == np.iinfo(np.int64).max) | (gap * gap <= best[rows] * dim)
                rows, j = rows[inside], j[inside]
                if not len(rows):
                    continue
                computed += len(rows)
                entry = self.order[j]
                d = ((parts[rows] - self.book[entry]) ** 2).sum(axis=1)
                better = (d < best[rows]) | ((d == best[rows]) & (entry < code[rows]))
                best[rows[better]], code[rows[better]] = d[better], entry[better]
                held.append((rows, j + step, step))
            sides = held
        return code, best, computed


def _rows(c: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """Rows x parts x dimension of a part, as integers."""
    x = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    most = float((1 << 30) // (width // parts))
    return np.clip(np.floor(x * scale), -most, most).astype(np.int64).reshape(len(x), parts, -1)


def _sums(books: list[np.ndarray], width: int, scale: int):
    """Per task: the sum of every component and the count of each entry, numbered as slots."""
    parts, entries, dim = len(books), len(books[0]), width // len(books)

    def run(batches):
        search = [EqualAverage.of(b) for b in books]
        total = np.zeros((parts, entries, dim + 1), np.int64)
        for b in batches:
            x = _rows(b.column(0), width, parts, scale)
            for p in range(parts):
                code, _, _ = search[p].nearest(x[:, p])
                np.add.at(total[p], code, np.pad(x[:, p], ((0, 0), (0, 1)), constant_values=1))
        slots = np.repeat(total[:, :, dim].ravel() > 0, dim + 1).nonzero()[0]
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total.ravel()[slots])], names=["slot", "total"])

    return run


def _encode(books: list[np.ndarray], width: int, scale: int):
    parts = len(books)

    def run(batches):
        search = [EqualAverage.of(b) for b in books]
        for b in batches:
            x = _rows(b.column(0), width, parts, scale)
            found = [search[p].nearest(x[:, p]) for p in range(parts)]
            codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
            error = sum((f[1] for f in found), np.zeros(len(x), np.int64))
            text = [r.tobytes().hex() for r in codes]
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array(text, pa.string()), pa.array(error)], names=["id", "label", "code", "error"]
            )

    return run


def _whole(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & finite


@dataclass(frozen=True)
class Codebooks:
    """The entries of each part position; ``width`` is the dimension of whole vectors."""

    books: list[np.ndarray]
    width: int
    scale: int

    def sha256(self) -> str:
        flat = np.concatenate([b.ravel() for b in self.books]) if self.books else []
        return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        parts = [b[i] for b, i in zip(self.books, bytes.fromhex(code))]
        return np.concatenate(parts) / self.scale


def train(
    table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> Codebooks | None:
    """Codebooks after ``rounds`` of Lloyd's iteration from the vectors of the smallest ids;
    None for a table without a usable vector."""
    if not 0 < entries <= 256:
        raise ValueError("a code byte tells up to 256 entries apart")
    v = table.select(F.col(vec_col).alias("v"), F.col(id_col).alias("i")).where(_whole(F.col(vec_col)))
    by_id = [F.asc_nulls_last("i"), F.asc("v")]
    first = v.where(F.size("v") > 0).orderBy(*by_id).limit(1).collect()
    if not first:
        return None
    width = len(first[0]["v"])
    if width % parts:
        raise ValueError(f"{width} components cannot be cut into {parts} equal parts")
    v = v.where(F.size("v") == width)
    start = pa.array([r["v"] for r in v.orderBy(*by_id).limit(entries).collect()], pa.list_(pa.float64()))
    x = _rows(start, width, parts, scale)
    books = [x[:, p].copy() for p in range(parts)]
    dim = width // parts
    for _ in range(rounds):
        sums = v.select("v").mapInArrow(_sums(books, width, scale), "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total"))
        total = np.zeros(parts * len(books[0]) * (dim + 1), np.int64)
        for r in sums.collect():  # at most entries x (dimension + parts) numbers
            total[r["slot"]] = r["total"]
        total = total.reshape(parts, -1, dim + 1)
        for p, book in enumerate(books):
            used = total[p, :, dim] > 0
            book[used] = total[p, used, :dim] // total[p, used, dim:]
    return Codebooks(books, width, scale)


def encode(table: DataFrame, books: Codebooks, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = None) -> DataFrame:
    """(id, label, code, error) of every usable vector: two hex digits a part, and the squared
    distances to the entries summed over the parts."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    v = table.where(_whole(F.col(vec_col)) & (F.size(vec_col) == books.width)).select(
        F.col(vec_col).alias("v"), F.col(id_col).alias("id"), label.alias("label")
    )
    kinds = dict(v.dtypes)
    return v.mapInArrow(_encode(books.books, books.width, books.scale), f"id {kinds['id']}, label {kinds['label']}, code string, error long")


def compress(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **kw) -> DataFrame:
    """``encode`` with codebooks trained on the table, the error summed over equal labels, and
    the digest of the codebooks.  Label sums are partial sums; the sums stand in a table of
    their own, so that adaptive execution can split a label that holds most rows."""
    books = train(table, id_col, vec_col, **kw)
    if books is None:
        coded = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        coded, digest = coded.limit(0), ""
    else:
        coded, digest = cut(encode(table, books, id_col, vec_col, label_col)), books.sha256()
    sums = cut(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")))
    out = coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle() -> str:
    """The same in DuckDB: parts against all entries of their codebook."""

    def assign(k: int) -> str:
        gap = "list_sum(list_transform(list_zip(x.w, b.w), lambda g: (g[1] - g[2]) * (g[1] - g[2])))"
        return (
            f"a{k} AS (SELECT vec_id, label, p, arg_min(e, d * 64 + e) AS e, min(d) AS d, any_value(w) AS w FROM "
            f"(SELECT x.vec_id, x.label, x.p, x.w, b.e, CAST({gap} AS BIGINT) AS d FROM parts x JOIN b{k} b ON x.p = b.p) "
            "GROUP BY vec_id, label, p)"
        )

    def move(k: int) -> str:
        mean = "CAST(floor(sum(w[i]) / count(*)) AS BIGINT)"
        return (
            f"m{k} AS (SELECT p, e, list(m ORDER BY i) AS w FROM (SELECT p, e, i, {mean} AS m FROM a{k - 1}, "
            f"(SELECT unnest(range(1, (SELECT max(len(w)) FROM parts) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e), "
            f"b{k} AS (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM b{k - 1} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)"
        )

    return (
        "WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v "
        "FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        "parts AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS w FROM kept, (SELECT unnest(range(16)) AS p)), "
        "b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w FROM parts "
        "WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)), "
        f"{assign(0)}, {move(1)}, {assign(1)}, {move(2)}, {assign(2)}, "
        "coded AS (SELECT vec_id, label, string_agg(lpad(lower(hex(CAST(e AS BIGINT))), 2, '0'), '' ORDER BY p) AS code, "
        "CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label), "
        "digest AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"
    )


ORACLE = _oracle()
