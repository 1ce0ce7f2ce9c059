"""Target-distribution importance resampling: documents drawn towards a target corpus by hashed
n-gram features.

Features are the runs of 1 to 3 consecutive words (ASCII letters and digits, and everything
beyond ASCII; A-Z lower-cased), joined by one space.  A feature's bucket is crc32 modulo 10000.
Bucket counts of the raw corpus and the target give every bucket a gain (log likelihood ratio,
add-one), a document's weight is the sum of the gains of its features, and Gumbel noise hashed
from its id turns the highest scores into a draw without replacement.

Inside a task each batch of text interns its n-grams in an open-addressed NumPy table: keys are
xxhash64 of the n-gram's bytes, an entry is taken for the same n-gram only after its bytes have
been compared, and a slot stores the n-gram's bucket and count.  Counting adds slot counts to
buckets; weighing gathers gains by the slot id of every occurrence.  All of it works on whole
arrays, one linear probe for all open n-grams at a time.

Scale: two scans of the text and no shuffle of n-grams: a task sends at most 10000 counts, the
gains (10000 numbers) go to the tasks, one narrow row a document is ranked by range partitions.
Texts are cut into pieces of about half a megabyte between words, so memory doesn't depend on length.

Defined results: a null or empty text, or one without words, has no features and weight 0; a
null doc_id draws its noise from ``42:`` alone; rows that repeat are scored one by one and ranked
next to each other; equal scores go by the smaller id (null ids last), then by fewer features and
smaller weight.  An empty table gives no rows, an empty target lets every bucket's target count
be 0.  Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import cut
from chorus.operators.ranking import position_within

BUCKETS = 10_000
ORDERS = 3
SHARE = (5, 100)  # of the documents that may be drawn
MIN_WORDS = 20
SEED = 42
PIECE = 1 << 19  # bytes of text that are interned together

_BYTE = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_IN_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")

# The five primes of XXH64
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
with np.errstate(over="ignore"):
    _LANES = np.array([_P1 + _P2, _P2, 0, np.uint64(0) - _P1], np.uint64)
_VECTOR = 63  # longer n-grams are hashed one by one


def _crc_tables() -> np.ndarray:
    """CRC-32 of one byte followed by 0 to 7 zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (t & np.uint32(1)))
    out = [t]
    for _ in range(7):
        out.append((out[-1] >> np.uint32(8)) ^ t[out[-1] & np.uint32(255)])
    return np.stack(out)


_CRC = _crc_tables()


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _xxh64(loads: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    if n < 32:
        h = np.full(len(i), _P5 + np.uint64(n))
    else:
        lanes = [np.full(len(i), x) for x in _LANES]
        for _ in range(n // 32):
            for k in range(4):
                lanes[k] = _rot(lanes[k] + loads[i] * _P2, 31) * _P1
                i = i + 8
        h = sum((_rot(x, r) for x, r in zip(lanes, (1, 7, 12, 18))), np.zeros(len(i), np.uint64))
        for x in lanes:
            h = (h ^ (_rot(x * _P2, 31) * _P1)) * _P1 + _P4
        h = h + np.uint64(n)
    for _ in range(n % 32 // 8):
        h = _rot(h ^ (_rot(loads[i] * _P2, 31) * _P1), 27) * _P1 + _P4
        i = i + 8
    if n & 4:
        h = _rot(h ^ ((loads[i] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        i = i + 4
    tail = loads[i] if n & 3 else None
    for k in range(n & 3):
        h = _rot(h ^ (((tail >> np.uint64(8 * k)) & np.uint64(255)) * _P5), 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _crc32(loads: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    c = np.full(len(i), 0xFFFFFFFF, np.uint32)
    for _ in range(n // 8):
        x = (loads[i] ^ c).view(np.uint8).reshape(-1, 8)
        c = _CRC[7][x[:, 0]]
        for k in range(1, 8):
            c ^= _CRC[7 - k][x[:, k]]
        i = i + 8
    tail = loads[i].view(np.uint8).reshape(-1, 8) if n & 7 else None
    for k in range(n & 7):
        c = _CRC[0][(c & np.uint32(255)).astype(np.uint8) ^ tail[:, k]] ^ (c >> np.uint32(8))
    return c ^ np.uint32(0xFFFFFFFF)


def _each(many, one, dtype, loads: np.ndarray, raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``many(loads, places, n)`` for the byte ranges of each length, ``one(bytes)`` for those
    that are longer than ``_VECTOR``; ``loads`` holds the eight bytes from each place on."""
    out = np.empty(len(at), dtype)
    of = np.minimum(size, _VECTOR + 1).astype(np.uint8)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=_VECTOR + 2)).tolist()
    for n in range(1, _VECTOR + 1):
        rows = order[ends[n - 1] : ends[n]]
        if len(rows):
            out[rows] = many(loads, at[rows], n)
    for r in order[ends[_VECTOR] :]:
        out[r] = one(raw[at[r] : at[r] + size[r]])
    return out


def xxh64(loads: np.ndarray, raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the byte ranges ``raw[at : at + size]``."""
    return _each(_xxh64, xxhash.xxh64_intdigest, np.uint64, loads, raw, at, size)


def crc32(loads: np.ndarray, raw: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the byte ranges."""
    return _each(_crc32, zlib.crc32, np.uint32, loads, raw, at, size)


def loads_of(raw: bytes) -> np.ndarray:
    """The eight bytes from each place on (zeros behind the end), read as one number."""
    return np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,)).copy()


class NgramTable:
    """Open-addressed table of the n-grams of one piece of text.  ``slot`` tells the entry of
    every occurrence; ``used``, ``bucket`` and ``count`` are parallel over the entries."""

    def __init__(self, text: np.ndarray, at: np.ndarray, size: np.ndarray, buckets: int = BUCKETS):
        raw = text.tobytes()
        self.loads = loads_of(raw)
        self.at, self.size = at, size
        self.key = xxh64(self.loads, raw, at, size)
        room = 1 << max(4, (2 * len(at)).bit_length())
        self.owner = np.full(room, -1)
        self.slot = self._place(room)
        self.used = np.flatnonzero(self.owner >= 0)
        first = self.owner[self.used]
        self.bucket = (crc32(self.loads, raw, at[first], size[first]) % np.uint32(buckets)).astype(np.int64)
        self.slot = (np.cumsum(self.owner >= 0) - 1)[self.slot]  # entries without the empty places
        self.count = np.bincount(self.slot, minlength=len(self.used))

    def _place(self, room: int) -> np.ndarray:
        slot = (self.key & np.uint64(room - 1)).astype(np.int64)
        rows = np.arange(len(slot))
        while len(rows):
            s = slot[rows]
            free = self.owner[s] < 0
            self.owner[s[free]] = rows[free]  # of several, the last one written owns the place
            rows = rows[self.owner[s] != rows]
            rows = rows[~self._same(rows, self.owner[slot[rows]])]
            slot[rows] = (slot[rows] + 1) & (room - 1)
        return slot

    def _same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether occurrences are the same n-gram: key, length and every byte."""
        same = (self.key[a] == self.key[b]) & (self.size[a] == self.size[b])
        rest = np.flatnonzero(same)
        done = 0
        while len(rest):
            left = self.size[a[rest]] - done
            x = self.loads[self.at[a[rest]] + done] ^ self.loads[self.at[b[rest]] + done]
            short = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
            equal = (x << short) == 0
            same[rest[~equal]] = False
            rest = rest[equal & (left > 8)]
            done += 8
        return same


def _pieces(texts: list[bytes | None], piece: int) -> Iterator[tuple[int, bytes, int]]:
    """(row, text, words at its start that only give context); cuts fall between words."""
    for row, t in enumerate(texts):
        if not t:
            continue
        lo, context = 0, []
        while lo < len(t):
            hi = lo + piece
            if hi < len(t):
                gap = _GAP.search(t, hi)
                hi = gap.start() if gap else len(t)
            yield row, b" ".join([*context, t[lo:hi]]), len(context)
            if hi < len(t):
                context = (context + _WORD.findall(t[lo:hi]))[-(ORDERS - 1) :]
            lo = hi


def _grouped(texts: list[bytes | None], piece: int) -> Iterator[list[tuple[int, bytes, int]]]:
    held, size = [], 0
    for x in _pieces(texts, piece):
        held.append(x)
        size += len(x[1])
        if size >= piece:
            yield held
            held, size = [], 0
    if held:
        yield held


def ngrams(pieces: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normal text (words with one space behind each), and per occurrence of an n-gram its
    place, its length and its row; at last the row of every counted word."""
    joined = _LOWER[np.frombuffer(b" ".join(x[1] for x in pieces) + b" ", np.uint8)]
    inside = _IN_WORD[joined]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = edge[::2], edge[1::2]
    joined[end] = 32
    inside[end] = True
    size = end - start
    place = np.cumsum(size + 1) - size - 1
    begins = np.cumsum([0, *(len(x[1]) + 1 for x in pieces)])
    of = np.searchsorted(begins, start, "right") - 1
    row = np.array([x[0] for x in pieces])[of]
    first = np.searchsorted(start, begins[:-1])
    index = np.arange(len(start)) - first[of]  # of the word in its piece
    new = index >= np.array([x[2] for x in pieces])[of]
    at, length, rows = [], [], []
    for n in range(1, ORDERS + 1):
        last = np.flatnonzero(new & (index >= n - 1))
        head = place[last - n + 1]
        at.append(head)
        length.append(place[last] + size[last] - head)
        rows.append(row[last])
    return joined[inside], np.concatenate(at), np.concatenate(length), np.concatenate(rows), row[new]


def _texts(c: pa.Array) -> list[bytes | None]:
    return c.cast(pa.binary()).to_pylist()


def _count(buckets: int, piece: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for pieces in _grouped(_texts(b.column(0)), piece):
                text, at, size, _, _ = ngrams(pieces)
                t = NgramTable(text, at, size, buckets)
                np.add.at(total, t.bucket, t.count)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, piece: int = PIECE) -> np.ndarray:
    """Occurrences of features per bucket over all texts."""
    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(_count(buckets, piece), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target and raw frequency, add-one, per bucket."""
    from math import floor, log

    s, t, k = int(raw.sum()), int(target.sum()), len(raw)
    return np.array(
        [floor(1000 * log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(raw.tolist(), target.tolist())], np.int64
    )


def _weigh(gain: np.ndarray, piece: int):
    def run(batches):
        for b in batches:
            n = b.num_rows
            features, words, weight = (np.zeros(n, np.int64) for _ in range(3))
            for pieces in _grouped(_texts(b.column(1)), piece):
                text, at, size, row, word = ngrams(pieces)
                t = NgramTable(text, at, size, len(gain))
                features += np.bincount(row, minlength=n)
                words += np.bincount(word, minlength=n)
                # sums of whole numbers below 2^53 are exact
                weight += np.bincount(row, gain[t.bucket][t.slot], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(features), pa.array(words), pa.array(weight)], names=["id", "n_features", "n_words", "weight"]
            )

    return run


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """(id, n_features, n_words, weight) of every document."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return src.mapInArrow(_weigh(gain, piece), f"id {dict(src.dtypes)['id']}, n_features long, n_words long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    share: tuple[int, int] = SHARE, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, piece: int = PIECE,
) -> DataFrame:
    """Every document's (id, n_features, weight, score, rank); rank counts from 1 over the
    drawn share of the documents with at least ``min_words`` words, and is null for the rest."""
    gain = gains(bucket_counts(docs, text_col, buckets, piece), bucket_counts(target, target_col, buckets, piece))
    noise = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(noise, 1, 8), 16, 10).cast("long") + 0.5) / 4294967296
    scored = cut(weigh(docs, gain, id_col, text_col, piece).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(u)))))
    may = scored.where(F.col("n_words") >= min_words)
    drawn = share[0] * may.count() // share[1]
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight")]
    ranked = position_within(may, [], order).withColumn("rank", F.when(F.col("pos") < drawn, F.col("pos") + 1))
    out = ranked.drop("pos").unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


# DuckDB has no crc32: the table of its 256 steps comes from the rule, a feature's bytes from
# its hexadecimal form.
ORACLE = """
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT doc_id, 1 AS raw, coalesce(text, '') AS text FROM documents UNION ALL SELECT item_id, 0, coalesce(text, '') FROM benchmark),
words AS MATERIALIZED (SELECT doc_id, raw, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
runs AS (SELECT doc_id, raw, n, array_to_string(w[i : i + n - 1], ' ') AS f FROM (
    SELECT doc_id, raw, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS n))),
hits AS MATERIALIZED (SELECT doc_id, raw, f, count(*) AS n FROM runs GROUP BY doc_id, raw, f),
features AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(encode(f)) * 2 + 1, 2),
    lambda i: (instr('0123456789ABCDEF', hex(f)[i]) - 1) * 16 + instr('0123456789ABCDEF', hex(f)[i + 1]) - 1)),
    lambda c, x: xor(t[xor(c & 255, x) + 1], c >> 8)), 4294967295) % 10000 AS b
    FROM (SELECT DISTINCT f FROM hits), crc),
buckets AS (SELECT b, sum(CASE WHEN raw = 1 THEN n ELSE 0 END) AS s, sum(CASE WHEN raw = 0 THEN n ELSE 0 END) AS t
    FROM hits JOIN features USING (f) GROUP BY b),
gains AS (SELECT b, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM buckets) + 10000)::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM buckets) + 10000)))) AS BIGINT) AS g FROM buckets),
weights AS (SELECT doc_id, sum(n) AS n_features, sum(n * g) AS weight FROM hits JOIN features USING (f) JOIN gains USING (b) WHERE raw = 1 GROUP BY doc_id),
scored AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM words LEFT JOIN weights USING (doc_id) WHERE raw = 1),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * (SELECT count(*) FROM ranked) // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
