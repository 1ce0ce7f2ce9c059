import zlib
from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from common_llm import ROWS, SF, edge_docs, empty_docs
from pyspark.sql import functions as F

from chorus.llm import repack

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts, window):
    """The pieces (piece, start, length, crc) of each text, by the tokenizer itself."""
    from tokenizers import Tokenizer

    out = []
    for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False):
        ids = np.array([*e.ids, 1], "<u4")
        cut = [ids[i : i + window] for i in range(0, len(ids), window)]
        out.append([(k, k * window, len(p), zlib.crc32(p)) for k, p in enumerate(cut)])
    return out


def check(packed, docs, window):
    """Every piece once, sequences gapless and within the window."""
    rows = packed.collect()
    want = sorted(str((i, *p)) for (i, _), ps in zip(docs, expected([t for _, t in docs], window)) for p in ps)
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    return len(seqs)


def fewest(sizes, window):
    """By trying every assignment."""
    for n in range(1, len(sizes) + 1):
        for a in product(range(n), repeat=len(sizes)):
            if np.bincount(a, sizes, n).max() <= window:
                return n
    return 0


def best_fit_slowly(sizes, window):
    bins = []
    for s in sorted(sizes, reverse=True):
        room = [(window - b, k) for k, b in enumerate(bins) if b + s <= window]
        if room:
            bins[min(room)[1]] += s
        else:
            bins.append(s)
    return sorted(bins)


def test_bound_holds_and_best_fit_is_best_fit():
    rng = np.random.default_rng(0)
    tight = beats_volume = 0
    for _ in range(250):
        window = int(rng.integers(4, 30))
        sizes = rng.integers(1, window + 1, int(rng.integers(1, 6)))
        low, best = repack.sequences_needed(sizes, window), fewest(sizes, window)
        assert low <= best
        tight += low == best
        beats_volume += low > -(-sizes.sum() // window)
    assert tight > 230 and beats_volume > 0
    for _ in range(50):
        sizes = rng.integers(1, 65, 200)
        seq, place = repack.best_fit_decreasing(sizes, 64)
        assert sorted(np.bincount(seq, sizes).astype(int).tolist()) == best_fit_slowly(sizes.tolist(), 64)


def test_whole_table_is_packed_to_its_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for lane_pieces in (60, repack.LANE_PIECES):  # many lanes and exchanges, or one
        packed = repack.pack(docs, PATH, lane_pieces=lane_pieces)
        used, least = repack.certificate(packed)
        assert check(packed, rows, 4096) == used and used <= least + (lane_pieces < 1000)


def test_exchange_saves_what_lanes_round_up(spark):
    items = spark.range(3000).select("id", (F.pmod(F.xxhash64("id"), F.lit(40)) + 1).alias("length"))
    out = repack.repack(items, 64, 100).toPandas()
    assert sorted(out.id) == list(range(3000))
    fill = out.groupby("seq").length.sum()
    assert fill.max() <= 64 and len(fill) <= -(-out.length.sum() // 64) + 4
    alone = sum(repack.best_fit_decreasing(g.length.to_numpy(), 64)[0].max() + 1 for _, g in out.groupby(out.id % 30))
    assert len(fill) < alone
    # pieces over half a window are certified without exchange
    big = spark.range(500).select("id", F.lit(40).cast("long").alias("length"))
    assert repack.repack(big, 64, 50).select("seq").distinct().count() == 500


def test_equal_rows_spread_over_the_lanes(spark):
    one = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(7).cast("long").alias("length"))
    items = repack.cut(one.select("*", F.monotonically_increasing_id().alias("key")))
    lanes = items.groupBy(F.pmod(F.xxhash64("key", F.lit(0)), F.lit(20))).count().toPandas()["count"]
    assert len(lanes) == 20 and lanes.max() < 200
    out = repack.repack(one, 64, 100).toPandas()
    assert len(out) == 2000 and out.groupby("seq").length.sum().max() <= 64 and out.seq.nunique() <= 2000 // 9 + 2


@pytest.mark.parametrize("window", [16, 4096])
def test_edges(spark, window):
    docs = edge_docs(spark)
    check(repack.pack(docs, PATH, window=window, lane_pieces=5), [(i, t) for i, t, _ in ROWS], window)
    assert repack.pack(empty_docs(spark), PATH).count() == 0
    assert repack.certificate(repack.pack(empty_docs(spark), PATH)) == (0, 0)


def test_ids_come_with_the_pieces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for r in repack.pack(docs, PATH, with_ids=True).collect():
        assert zlib.crc32(np.array(r["ids"], "<u4")) == r["ids_crc32"] and len(r["ids"]) == r["length"]
