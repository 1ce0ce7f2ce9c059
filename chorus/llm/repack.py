"""Bound-certified repacking: documents in as few sequences as possible, cut only where one is
longer than a sequence.

A document is its token ids and an end id; longer ones are cut into whole sequences and a rest.
Pieces are dealt into lanes of about ``LANE_PIECES``, every lane is packed by best-fit decreasing,
and dual feasible functions give a lower bound on the sequences that its pieces need.  A lane
whose number of sequences equals its bound is certified: no packing of its pieces is smaller.  A
lane with a gap gives the documents of all its sequences that are not full to the exchange; a
certified lane gives those of its emptiest one, whose padding is only the lane's rounding.  The
exchanged documents are dealt anew among fewer lanes and packed again, until they fit one lane or
a round saves nothing (its result is then taken only if it is no worse).  ``certificate`` compares
the whole packing with the bound of all pieces together.

Lower bounds (fractions of whole numbers, so they are exact): the sum of the sizes; the functions
u(k), k up to 32, that round (k+1)x down to k-ths; for every size e up to half a sequence the
function that drops pieces below e and counts pieces above 1 - e whole; and the one that gives
pieces between e and one half the share 1 / floor(1/e).

Defined results: a null or empty text is its end id alone; rows that repeat, and null ids, are
packed one by one; pieces of one size are told apart by a number given to each row, so that equal
rows spread over the lanes; an empty table gives no pieces.  Very long texts are cut into pieces
of which each is a row.  Other columns are ignored.

Scale: token ids stay in the task that made them unless asked for (``with_ids``), so a row in the
lanes is some sixty bytes; a task holds one lane at a time.  The driver sees three counts a round.
"""

from __future__ import annotations

import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import by_group, cut
from chorus.llm.packing import END, tokenizer

WINDOW = 4096
LANE_PIECES = 16384
_BIN_BITS = 20  # sequences of a lane; below the round's 10 bits and the lane's 32
STEPS = 32


def best_fit_decreasing(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and place in it of every piece; larger pieces first, each into the fullest
    sequence that has room for it."""
    seq, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    at: dict[int, list[int]] = {}  # room left -> sequences
    rooms, n = 0, 0  # bit r: some sequence has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = at[room].pop()
            if not at[room]:
                rooms ^= 1 << room
        else:
            room, b, n = window, n, n + 1
        seq[i], place[i] = b, window - room
        if left := room - s:
            at.setdefault(left, []).append(b)
            rooms |= 1 << left
    return seq, place


def bounds(count: np.ndarray, window: int) -> Fraction:
    """The largest dual-feasible sum for ``count[x]`` pieces of each size x up to ``window``:
    no packing has fewer sequences."""
    x = np.arange(window + 1)
    count = np.asarray(count, np.int64)
    best = Fraction(int((count * x).sum()), window)
    for k in range(1, STEPS + 1):
        v = np.where((k + 1) * x % window == 0, k * x, window * ((k + 1) * x // window))
        best = max(best, Fraction(int((count * v).sum()), k * window))
    n, s = np.cumsum(count), np.cumsum(count * x)
    e = np.flatnonzero(count[: window // 2 + 1])
    e = e[e > 0]
    if len(e):
        large = n[-1] - n[window - e]
        best = max(best, Fraction(int((window * large + s[window - e] - s[e - 1]).max()), window))
    big = np.flatnonzero(count[window // 2 + 1 :]) + window // 2 + 1
    for size in e.tolist():
        q = window // size
        v = int((count[big] * (q - (window - big) // size)).sum() + n[window // 2] - n[size - 1])
        if v > best * q:
            best = Fraction(v, q)
    return best


def sequences_needed(sizes: np.ndarray, window: int) -> int:
    return -(-bounds(np.bincount(sizes, minlength=window + 1), window) // 1)


def _pieces(path: str, window: int, with_ids: bool):
    def run(batches):
        t = tokenizer(path)
        end = np.array([END], t.dtype).tobytes()
        for b in batches:
            rows, cols = [], {n: [] for n in ("piece", "start", "length", "crc", "ids")}
            for r, text in enumerate(b.column(1)):
                ids = np.frombuffer(t.encode(text.as_py() or "") + end, t.dtype).astype("<u4")
                for k, start in enumerate(range(0, len(ids), window)):
                    part = ids[start : start + window]
                    rows.append(r)
                    for n, v in zip(cols, (k, start, len(part), zlib.crc32(part), part if with_ids else None)):
                        cols[n].append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            out = [pa.array(v, k) for v, k in zip(cols.values(), kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *out], names=["id", *cols])

    return run


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc, ids) of every document; ids are null unless asked for."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    schema = f"id {dict(src.dtypes)['id']}, piece int, start long, length long, crc long, ids array<int>"
    return src.mapInArrow(_pieces(path, window, with_ids), schema)


def _lane(window: int, number: int):
    """Packs one lane; ``again`` marks the pieces that go to the exchange."""

    def run(t: pa.Table):
        sizes = t.column("length").to_numpy()
        seq, place = best_fit_decreasing(sizes, window)
        fill = np.bincount(seq, sizes).astype(np.int64)
        if len(fill) > sequences_needed(sizes, window):
            give = fill < window
        else:
            give = np.zeros(len(fill), bool)
            give[fill.argmin()] = fill.min() < window
        lane = t.column("lane")[0].as_py()
        ids = (number << 52) + (lane << _BIN_BITS) + seq
        new = {"seq": pa.array(ids), "place": pa.array(place), "again": pa.array(give[seq])}
        t = t.drop_columns(["lane"])
        for n, v in new.items():
            t = t.set_column(t.schema.get_field_index(n), n, v)
        yield from t.to_batches()

    return run


def _exchange(items: DataFrame, lanes: int, number: int, window: int) -> DataFrame:
    lane = F.pmod(F.xxhash64("key", F.lit(number)), F.lit(lanes)).alias("lane")
    schema = ", ".join(f"{n} {k}" for n, k in items.dtypes)
    return cut(by_group(items.select("*", lane), ["lane"], _lane(window, number), schema))


def _tally(df: DataFrame) -> tuple[int, int, int]:
    """Sequences; of them those given to the exchange; their pieces."""
    first = F.col("place") == 0
    r = df.agg(F.count_if(first), F.count_if(first & F.col("again")), F.count_if("again")).first()
    return r[0], r[1], r[2]


def repack(items: DataFrame, window: int = WINDOW, lane_pieces: int = LANE_PIECES) -> DataFrame:
    """``items`` (any columns, ``length`` up to ``window`` among them) with ``seq`` and ``place``."""
    blank = [F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("again")]
    rest = cut(items.select("*", F.monotonically_increasing_id().alias("key"), *blank))
    left, used, done, number = rest.count(), None, [], 0
    while True:
        lanes = max(1, -(-left // lane_pieces))
        packed = _exchange(rest, lanes, number, window)
        total, given, waiting = _tally(packed)
        if used is not None and total > used:
            done.append(rest)  # as they stood before
            break
        if lanes == 1 or total == used or not waiting:
            done.append(packed)
            break
        done.append(packed.where(~F.col("again")))
        rest, left, used, number = packed.where("again"), waiting, given, number + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("key", "again")


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
    lane_pieces: int = LANE_PIECES, with_ids: bool = False,
) -> DataFrame:
    """Pieces (id, piece, start, length, ids_crc32, sequence_id, offset), and their token ids
    where asked for."""
    out = repack(pieces(docs, path, id_col, text_col, window, with_ids), window, lane_pieces)
    names = {"id": id_col, "crc": "ids_crc32", "seq": "sequence_id", "place": "offset"}
    out = out.select(*[F.col(c).alias(names.get(c, c)) for c in ("id", "piece", "start", "length", "crc", "seq", "place", "ids")])
    return out if with_ids else out.drop("ids")


def certificate(packed: DataFrame, window: int = WINDOW) -> tuple[int, int]:
    """Sequences of a packing, and the bound that no packing of its pieces goes below."""
    r = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("offset") == 0).alias("first")).collect()
    count = np.zeros(window + 1, np.int64)  # at most one row a size
    for x in r:
        count[x["length"]] = x["n"]
    return sum(x["first"] for x in r), int(-(-bounds(count, window) // 1))
