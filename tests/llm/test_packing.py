import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from common_llm import ROWS, SF, edge_docs, empty_docs

from chorus.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [e.ids + [packing.END] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(pieces: pd.DataFrame, docs: list[tuple], window: int = 2048):
    """Every id of every document in exactly one piece, sequences gapless and in bounds."""
    from collections import defaultdict

    ids = defaultdict(list)
    for (i, _), x in zip(docs, whole_ids([t for _, t in docs])):
        ids[i].append(x)
    seen = defaultdict(list)
    for p in pieces.itertuples():
        seen[p.doc_id if p.doc_id == p.doc_id else None].append(p)
    for i, lists in ids.items():
        want = sorted(sum(map(len, lists)) for _ in [0])
        assert sum(p.length for p in seen[i]) == want[0]
        if len(lists) == 1:
            at = 0
            for p in sorted(seen[i], key=lambda p: p.start):
                part = np.array(lists[0][at : at + p.length], "<u4").tobytes()
                assert p.start == at and p.doc_tokens == len(lists[0]) and p.ids_crc32 == zlib.crc32(part)
                at += p.length
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= window


def test_pieces_and_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    pieces = packing.pack(docs, PATH).toPandas()
    check(pieces, rows)
    size = pieces.groupby("sequence_id").length.sum()
    assert (2048 - size).sum() / size.sum() < 0.01


def test_fast_path_equals_tokenizer():
    t = packing.WordTokenizer(PATH)
    texts = ["Don't, they'll: 3x 12% 'S end's", "Ünïcödé ŉ İ ß Straße ǅ", "a b\u0085c d", "½ ² xµ ﬁ", "é Å ΣΑΣ",
             "<|endoftext|> x", "<|END|>", "a\x1cb \x00 \x0b", "—…’“x” €5 ⁂", "", " \n ", "漢字 ひらがな 한글 \U0001f600", "A" * 500]
    for x in texts:
        assert np.frombuffer(t.encode(x), t.dtype).tolist() == t.whole.encode(x, add_special_tokens=False).ids, x


def test_fast_path_over_all_plain_characters():
    t = packing.WordTokenizer(PATH)
    for c in range(0x3000):
        x = f"ab{chr(c)}Cd{chr(c)} {chr(c)}'s"
        assert np.frombuffer(t.encode(x), t.dtype).tolist() == t.whole.encode(x, add_special_tokens=False).ids, hex(c)


def test_sum_of_squares_choice():
    """Each placement has the smallest sum of squared level counts of all that are possible."""
    rng = np.random.default_rng(3)
    p = packing.SumOfSquares(32)
    for n in rng.integers(1, 32, 500):
        before = p.level.copy()
        options = [sum(_moved(before, h, int(n), 32) ** 2) for h in range(32) if h + n <= 32 and (h == 0 or before[h])]
        p.place(0, np.zeros(n, "<u2"))
        assert (p.level[1:32] ** 2).sum() == min(options)


def _moved(level, h, n, size):
    x = level.copy()
    x[h] -= h > 0
    if h + n < size:
        x[h + n] += 1
    return x[1:size]


def test_edges(spark):
    docs = edge_docs(spark)
    pieces = packing.pack(docs, PATH, lane_docs=3).toPandas()
    check(pieces, [(i, t) for i, t, _ in ROWS])
    assert packing.pack(empty_docs(spark), PATH).count() == 0
    with pytest.raises(Exception):
        packing.pack(docs, "/no/such/file").count()
    assert SF
