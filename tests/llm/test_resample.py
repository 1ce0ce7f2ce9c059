import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from common_llm import LONG, ROWS, SF, edge_docs, empty_docs

from chorus.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def brute(docs, target):
    """[(doc_id, n_features, weight, score, rank)] sorted as text."""
    def counts(texts):
        c = Counter()
        for t in texts:
            for f, n in features(t)[1].items():
                c[zlib.crc32(f.encode()) % 10000] += n
        return c

    raw, want = counts(t for _, t in docs), counts(target)
    s, t = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + 10000) / ((raw[b] + 1) * (t + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        words, f = features(text)
        weight = sum(n * gain[zlib.crc32(x.encode()) % 10000] for x, n in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, sum(f.values()), weight, weight + noise, None, words])
    may = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(may[: 5 * len(may) // 100]):
        r[4] = k + 1
    return sorted(str(tuple(r[:5])) for r in rows)


def got(df):
    return sorted(str((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in df.collect())


@pytest.mark.parametrize("piece", [100, 1 << 19])
def test_equal_to_brute_force_at_any_piece_size(spark, piece):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows, [r["text"] for r in bench.collect()])
    assert got(resample.resample(docs.repartition(5), bench, piece=piece)) == want


def test_edges(spark):
    docs = edge_docs(spark)
    more = spark.createDataFrame([(100 + i, f"{LONG[:400]} {i % 4}", "en", "s", None, *["x"] * 15) for i in range(60)], docs.schema)
    rows = [(r["doc_id"], r["text"]) for r in docs.unionByName(more).collect()]
    assert len(rows) == len(ROWS) + 60
    target = ["the long line", None, "", "ÄÖ É mill HILL"]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, bucket string")
    out = resample.resample(docs.unionByName(more), bench)
    assert got(out) == brute(rows, target)
    assert got(resample.resample(docs, bench.limit(0))) == brute([(i, t) for i, t, _ in ROWS], [])
    assert resample.resample(empty_docs(spark), bench).count() == 0


def test_hashes_and_bytes():
    raw = bytes(np.random.default_rng(0).integers(0, 256, 900, dtype=np.uint8))
    loads = resample.loads_of(raw)
    at = np.arange(600)
    size = at % 140 + 1
    spans = [raw[a : a + n] for a, n in zip(at, size)]
    assert resample.xxh64(loads, raw, at, size).tolist() == [xxhash.xxh64_intdigest(x) for x in spans]
    assert resample.crc32(loads, raw, at, size).tolist() == [zlib.crc32(x) for x in spans]


def test_equal_keys_with_other_bytes_stay_apart(monkeypatch):
    """With one hash for all n-grams, bytes alone tell them apart."""
    monkeypatch.setattr(resample, "xxh64", lambda loads, raw, at, size: np.zeros(len(at), np.uint64))
    text = b"ab abc abcdefgh abcdefgi abcdefgh ab " + b"x" * 30 + b" " + b"x" * 29 + b"y"
    body, at, size, row, _ = resample.ngrams([(0, text, 0)])
    t = resample.NgramTable(body, at, size)
    _, want = features(text.decode())
    assert len(t.used) == len(want) and sorted(t.count.tolist()) == sorted(want.values())
    seen = {}
    for a, n, s in zip(at, size, t.slot):
        assert seen.setdefault(s, body[a : a + n].tobytes()) == body[a : a + n].tobytes()
    assert {zlib.crc32(x) % 10000 for x in seen.values()} == set(t.bucket.tolist())
