"""Subword counts of texts by byte-level BPE: the merge ranks of a public tokenizer file go to the
tasks as a broadcast, every distinct word is merged once per worker (greedily, lowest rank first),
and a text's count is summed where the text is; no token crosses a shuffle.

The file is a parameter.  Supported is what its parts say: NFC, white space, lower case, a split
pattern, byte-level symbols, a word-end suffix.  Defined results: a null text counts as empty; an
empty text has the special tokens only; a special token's own string counts as one.
"""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = 2  # start and end
MOST_MERGES = 1 << 20  # beyond, the ranks are no broadcast
WORDS = 200_000  # remembered per worker


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols that are left after all merges."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best, at = min((ranks.get(p, len(ranks)), i) for i, p in enumerate(zip(symbols, symbols[1:])))
        if best == len(ranks):
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return len(symbols)


class Subwords:
    def __init__(self, spec: dict):
        import regex

        self.ranks, self.suffix = spec["ranks"], spec["suffix"]
        self.symbols = byte_symbols()
        self.split = regex.compile(spec["pattern"].replace(r"\s", r"\p{White_Space}"))
        self.special = regex.compile("|".join(map(regex.escape, spec["special"])) or r"(?!)")
        self.new: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def word(self, w: str) -> int:
        n = self.new.get(w)
        if n is None:
            n = self.old.get(w)
            if n is None:
                symbols = [self.symbols[b] for b in w.encode()]
                symbols[-1] += self.suffix
                n = merge_count(symbols, self.ranks)
            if len(self.new) >= WORDS:
                self.new, self.old = {}, self.new
            self.new[w] = n
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text)
        n = len(parts) - 1
        for p in parts:
            p = unicodedata.normalize("NFC", p)
            p = p.lower() if p.isascii() else "".join(map(str.lower, p))  # one by one: no final sigma
            n += sum(map(self.word, self.split.findall(p)))
        return n


def read_merges(path: str) -> dict:
    """Ranks, word-end suffix, split pattern and special tokens of a tokenizer file."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    if len(t["model"]["merges"]) > MOST_MERGES:
        raise ValueError("too many merges for a broadcast")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in t["model"]["merges"]]
    steps = t["pre_tokenizer"].get("pretokenizers", [t["pre_tokenizer"]])
    pattern = next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split")
    return {
        "ranks": {m: i for i, m in enumerate(merges)}, "suffix": t["model"].get("end_of_word_suffix") or "",
        "pattern": pattern, "special": [a["content"] for a in t["added_tokens"]],
    }


def subword_counts(df: DataFrame, text: str, path: str, out: str = "n_subwords", special: int = SPECIAL) -> DataFrame:
    """``df`` with the number of subwords of ``text``, special tokens included."""
    spec = df.sparkSession.sparkContext.broadcast(read_merges(path))
    src = df.withColumn("_t", F.col(text).cast("string"))

    def run(batches):
        s = Subwords(spec.value)
        for b in batches:
            n = pa.array([s.count(t or "") + special for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], out])

    schema = ", ".join([*(f"`{n}` {k}" for n, k in src.dtypes[:-1]), f"{out} long"])
    return src.mapInArrow(run, schema)
