"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set holds its distinct five-word shingles (64-bit hashes) and its signature
the minimum of 128 hash functions.  Documents with equal sets form a class; one row per
class goes on.

The similarity is a parameter; ``match``, the equal coordinates that a pair must have, follows
from it.

* Posting: every (coordinate, value) of a class is a token.  Tokens are ordered from rare
  to frequent; two classes with at least ``match`` equal coordinates share a token among
  the first ``128 - match + 1`` of each (prefix).  Tokens that only one class has are
  counted and skipped, long lists come last and are mostly skipped too.
* Classes that share a prefix token, directly or through others, are one cluster.  A
  cluster is dealt into blocks of ``CHUNK`` classes; a task gets two blocks.
* In the task, collisions are counted over all 128 coordinates, pairs with ``match`` or more
  are confirmed on the full sets, and only links that join two parts are returned: pairs
  never become rows, and no list is held whole.

Defined results: a null or wordless text has an empty set and links with nothing; fewer
than five words are one shingle; a null doc_id takes no part (component null, kept);
rows that repeat a doc_id are separate sets of one document.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import batch, by_group, cut, own
from chorus.operators.graph import connected_components

WORDS = 5
COORDS = 128
MISS = 5e-5  # most of the pairs exactly at the threshold that may fail the match bound
CHUNK = 128
SHARE = (85, 100)

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 2**63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 2**63, COORDS, dtype=np.uint64)
_COORD = np.arange(COORDS, dtype=np.uint64) << np.uint64(32)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def match_bound(share: tuple[int, int]) -> int:
    """The largest number of equal coordinates that a pair at the threshold misses with a
    probability of at most ``MISS``: 92 at 0.85, 84 at 0.8."""
    p, below, m = share[0] / share[1], 0.0, 0
    while m < COORDS and below + (at := comb(COORDS, m) * p**m * (1 - p) ** (COORDS - m)) <= MISS:
        below, m = below + at, m + 1
    return max(m, 1)


class _WordHashes(dict):
    """Word -> 64-bit hash, remembered up to a fixed number of words."""

    def __missing__(self, word):
        if len(self) >= 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text (UTF-8)."""
    words = text.lower().split() if text else ()  # bytes: only A-Z and ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(WORDS, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        s = (s ^ h[j : len(h) - n + 1 + j]) * _PRIME
        s ^= s >> np.uint64(29)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """128 minima (32 bits each) of a non-empty set."""
    low = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 4096):
        v = (s[None, i : i + 4096] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(low, v.min(axis=1), out=low)
    return low >> np.uint64(32)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


_SIG = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def _describe(batches):
    for b in batches:
        rows = {f.name: [] for f in _SIG}
        for i, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary())):
            s = shingle_set(text.as_py())
            h = _set_key(s) if len(s) else (0, 0)
            for name, v in zip(rows, (i, len(s), *h, (signature(s) | _COORD).astype(np.int64) if len(s) else None)):
                rows[name].append(v)
            if len(rows["id"]) >= 1000:
                yield batch(_SIG, **rows)
                rows = {f.name: [] for f in _SIG}
        yield batch(_SIG, **rows)


_MEMBER = pa.schema([("id", pa.int64()), ("cluster", pa.int64()), ("chunks", pa.int32()), ("set", pa.binary())])


def _sets(batches):
    """Full sets of cluster members; a row whose text has another set is passed over."""
    for b in batches:
        rows = {f.name: [] for f in _MEMBER}
        cols = [b.column(n).to_pylist() for n in ("id", "cluster", "chunks", "h1", "h2")]
        for i, cluster, chunks, h1, h2, text in zip(*cols, b.column("t").cast(pa.binary())):
            s = shingle_set(text.as_py())
            if len(s) and _set_key(s) == (h1, h2):
                for name, v in zip(rows, (i, cluster, chunks, s.tobytes())):
                    rows[name].append(v)
        yield batch(_MEMBER, **rows)


_EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def _links(match: int, share: tuple[int, int]):
    """Function for the links inside one pair of blocks that join two parts, confirmed on full sets."""

    def run(table: pa.Table):
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, at = table.column("id").to_numpy(), table.column("c").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
        sig = np.stack([signature(s) for s in sets]).astype(np.uint32)
        left, right = np.flatnonzero(at == i), np.flatnonzero(at == j)
        hits = np.zeros((len(left), len(right)), np.uint8)
        for k in range(COORDS):
            hits += sig[left, k][:, None] == sig[right, k][None, :]
        size = np.array([len(s) for s in sets])
        a, b = size[left][:, None], size[right][None, :]
        ok = (hits >= match) & (share[1] * np.minimum(a, b) >= share[0] * np.maximum(a, b))
        if i == j:
            ok &= ids[left][:, None] < ids[right][None, :]
        x, y = np.nonzero(ok)
        order = np.argsort(-hits[x, y].astype(int), kind="stable")
        parent = list(range(len(ids)))

        def root(v):
            while parent[v] != v:
                parent[v] = v = parent[parent[v]]
            return v

        src, dst = [], []
        for u, v in zip(left[x[order]], right[y[order]]):
            if (p := root(u)) == (q := root(v)):
                continue
            both = len(np.intersect1d(sets[u], sets[v], assume_unique=True))
            if share[1] * both >= share[0] * (size[u] + size[v] - both):
                parent[p] = q
                src.append(ids[u]), dst.append(ids[v])
        if src:
            yield batch(_EDGE, src=src, dst=dst)

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = SHARE
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``; ``share`` is the least
    similarity as a fraction."""
    match = match_bound(share)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    sigs = cut(src.mapInArrow(_describe, "id long, n long, h1 long, h2 long, tokens array<long>"))
    classes = cut(
        sigs.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("tokens").alias("tokens"))
    )

    # prefix of each class: its rarest tokens, of which those with one class need no list
    token = classes.select("h1", "h2", "rep", F.explode("tokens").alias("token"))
    df = token.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = token.join(df.select(own("token").alias("k"), "df"), F.col("token") == F.col("k"))
    shared = shared.groupBy("h1", "h2", "rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("s"))
    posting = shared.where(F.size("s") >= match).select(
        "h1", "h2", "rep", F.explode(F.slice("s", F.lit(1), F.size("s") - match + 1)).alias("s")
    ).select("h1", "h2", "rep", "s.token")
    posting = cut(posting)

    # clusters: classes that share prefix tokens, through the smallest class of each list.
    # A class is named by its smallest doc_id; where doc_ids repeat, several classes may
    # share a name and are then simply one node.
    hubs = posting.groupBy("token").agg(F.min("rep").alias("hub"), F.max("rep").alias("far"), F.count(F.lit(1)).alias("n"))
    hubs = hubs.where("n > 1").select(own("token").alias("k"), "hub")
    spokes = posting.join(hubs, F.col("token") == F.col("k"))
    cluster = cut(connected_components(spokes.select("rep", "hub").distinct(), "rep", "hub"))
    chunks = cluster.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    cluster = cluster.join(chunks.select(own("component").alias("k"), "chunks"), F.col("component") == F.col("k"))
    members = posting.select("h1", "h2", "rep").distinct().join(
        cluster.select(own("node").alias("node"), F.col("component").alias("cluster"), "chunks"), F.col("rep") == F.col("node")
    )

    # blocks of full sets; texts are read again for members only
    members = members.select("h1", "h2", own("rep").alias("id2"), "cluster", "chunks")
    texts = src.join(members, F.col("id") == F.col("id2")).select("id", "cluster", "chunks", "h1", "h2", "t")
    sets = texts.mapInArrow(_sets, "id long, cluster long, chunks int, set binary")
    sets = sets.withColumn("c", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    blocks = sets.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "cluster", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "id", "set"
    )
    edges = by_group(blocks, ["cluster", "i", "j"], _links(match, share), "src long, dst long")
    comp = connected_components(edges)

    named = classes.select(own("h1").alias("g1"), own("h2").alias("g2"), "rep")
    comp = comp.select(own("node").alias("node"), "component")
    named = named.join(comp, F.col("rep") == F.col("node"), "left").select(
        own("g1").alias("g1"), own("g2").alias("g2"), F.coalesce("component", "rep").alias("component")
    )
    out = sigs.select("id", "n", "h1", "h2").join(
        named, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left"
    )
    comp_id = F.coalesce("component", "id")
    return out.select(
        "id", F.col("n").alias("n_shingles"), comp_id.alias("component_id"), F.coalesce(F.col("id") == comp_id, F.lit(True)).alias("kept")
    )
