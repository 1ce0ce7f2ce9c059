"""One-pass replacement against the loop; subword counts against the public tokenizer."""

import random
import time

import pytest
from pyspark.sql import functions as F

from chorus.functions import replace
from chorus.functions import text as tx
from chorus.operators import subwords


def loop(text, mapping):
    for k, v in mapping:
        text = text.replace(k, f"<{v}>")
    return text


def test_any_map_gives_the_loop_s_text():
    rng = random.Random(7)
    passes = 0
    for _ in range(3000):
        letters = rng.choice(["abc", "abcdefgh", "ab<"])
        keys = ["".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
        mapping = [(k, rng.choice(["X", "YY", "a", ""])) for k in keys]
        text = "".join(rng.choices(letters + "z", k=30))
        assert replace.replacer(mapping)(text) == loop(text, mapping), (mapping, text)
        passes += any(isinstance(s, dict) and len(s) > 1 for s in replace.plan(mapping))
    assert passes > 300


def test_thousands_of_keys_cost_one_pass(spark):
    keys = [chr(c) + m for c in range(0x1F300, 0x1F900) for m in ("️", "")]  # the longer key first
    mapping = [(k, f"name {i}") for i, k in enumerate(keys)]
    assert len(mapping) > 3000 and [type(s) for s in replace.plan(mapping)] == [dict]
    texts = ["plain", "", "a\U0001f600️b\U0001f601 \U0001f602️️", "\U0001f8ff" * 3]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    got = [r[0] for r in df.select(tx.emoji_to_text("t", mapping)).collect()]
    assert got == [loop(t, mapping) for t in texts] + [None]
    long = "word \U0001f600 and more words without any of them " * 20000

    def seconds(m):
        run = replace.replacer(m)
        t0 = time.perf_counter()
        run(long)
        return time.perf_counter() - t0

    few, many = (min(seconds(m) for _ in range(3)) for m in ([x for x in mapping if 0x1F5E0 <= ord(x[0][0]) < 0x1F610], mapping))
    assert many < 4 * few + 0.05


def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_subword_counts_equal_the_public_tokenizer(spark):
    path = tokenizer_path()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    odd = ["Don't, they'll: 3x 12%", "ΣΑΣ ŉ İ ß ǅ ﬁ ½", "<|endoftext|> x <|END|>", "a\x1cb \x85  c", "漢字 ひらがな 한글 \U0001f600", "é É", "A" * 400, "", None]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    df = docs.unionByName(spark.createDataFrame([(x,) for x in odd], "text string"))
    for r in subwords.subword_counts(df, "text", path).collect():
        want = len(t.encode(r["text"] or "", add_special_tokens=False).ids) + subwords.SPECIAL
        assert r["n_subwords"] == want, (r["text"] or "")[:60]


def test_merges_go_by_rank():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    assert subwords.merge_count(list("abc"), ranks) == 1 and subwords.merge_count(list("abab"), ranks) == 2
    assert subwords.merge_count(["x"], ranks) == 1 and subwords.merge_count(list("xyz"), ranks) == 3
    assert len(set(subwords.byte_symbols())) == 256 and F is not None
