"""Sum-of-squares online packing of token sequences into fixed windows.

A document is its token ids and an end id.  Whole windows are cut off its front; the rest
goes to the open window whose fill level gives the smallest sum of squared level counts
(a level array holds how many partially filled windows stand at each level).  Documents
are dealt by hash into lanes of about ``LANE_DOCS``; every lane packs on its own, in hash
order, and at its end runs the windows that are still open together, cutting freely, so
that at most one window a lane needs padding.

Defined results: a null or empty text is its end id alone; rows that repeat a doc_id are
packed one by one; a null doc_id is kept as null; an empty table gives no pieces.

Scale: token ids cross one shuffle, as 16-bit numbers where the vocabulary allows; a task
holds the open windows of one lane (at most one window's tokens per open window).
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END = 1
LANE_DOCS = 4096

# Text made of these characters only is the same under the tokenizer's normaliser but for
# case, and its letters and digits are told by plain ranges; other texts go to the
# tokenizer whole.
_PLAIN = "\t-\r -~¡-©«-±´¶-¸»¿À-įı-ſ‐-‧‰-⁞€"
_OTHER = re.compile(f"[^{_PLAIN}]|<\\|(?:start|end)oftext\\|>")
_LETTER = "a-zÀ-ÖØ-öø-ſ"
_PRE = re.compile(f"[{_LETTER}]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\\s{_LETTER}0-9]+")


class WordTokenizer:
    """``tokenizers`` ids of whole texts, with the ids of words remembered (bounded)."""

    limit = 600_000

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.chars = _Table(lambda c: to_bytes(chr(c))[0][0])
        self.dtype = "<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4"
        self.code = {"<u2": "H", "<u4": "I"}[self.dtype]
        self.words = _Memo(self._word, self.limit)

    def _word(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(word.translate(self.chars))]).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian numbers of ``dtype``."""
        if _OTHER.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        return b"".join(map(self.words.__getitem__, _PRE.findall(text.lower())))


class _Table(dict):
    """``make(key)`` by key, each made once."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        self[key] = v = self.make(key)
        return v


class _Memo(_Table):
    """``make(key)`` by key in two generations: a full one becomes the old one, and what is
    asked for again moves on, so that frequent keys stay."""

    def __init__(self, make, limit: int):
        super().__init__(make)
        self.old, self.limit = {}, limit // 2

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _tokenise(path: str):
    def run(batches):
        t = tokenizer(path)
        end = np.array([END], t.dtype).tobytes()
        for b in batches:
            ids = [t.encode(x.as_py() or "") + end for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    return run


class SumOfSquares:
    """Packer of one lane; ``place`` and ``finish`` return pieces of finished windows as
    (id, start, ids, total, window, offset)."""

    def __init__(self, window: int = WINDOW):
        self.size = window
        self.level = np.zeros(window + 1, np.int64)  # windows at each partial fill
        self.at_level: dict[int, list[int]] = {}
        self.open: dict[int, list[tuple]] = {}
        self.next = 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, doc, ids: np.ndarray) -> list[tuple]:
        out, start, n = [], 0, len(ids)
        while n - start >= self.size:
            out.append((doc, start, ids[start : start + self.size], n, self._new(), 0))
            start += self.size
        s = n - start
        if not s:
            return out
        h = np.flatnonzero(self.level[1 : self.size - s + 1])[::-1] + 1
        fill, cost = 0, 2 * self.level[s] + 1  # of opening a window
        if len(h):
            change = 2 * (self.level[h + s] - self.level[h] + 1)
            change[h + s == self.size] = 1 - 2 * self.level[self.size - s]
            k = int(change.argmin())
            if change[k] <= cost:
                fill = int(h[k])
        if fill:
            w = self.at_level[fill].pop()
            self.level[fill] -= 1
        else:
            w = self._new()
        pieces = self.open.setdefault(w, [])
        pieces.append((doc, start, ids[start:], n, w, fill))
        if fill + s == self.size:
            return out + self.open.pop(w)
        self.level[fill + s] += 1
        self.at_level.setdefault(fill + s, []).append(w)
        return out

    def finish(self) -> list[tuple]:
        """The open windows run together, cut where a window is full."""
        out, fill, w = [], 0, None
        for pieces in sorted(self.open.values(), key=lambda p: -sum(len(x[2]) for x in p)):
            for doc, start, ids, total, _, _ in pieces:
                while len(ids):
                    if fill in (0, self.size):
                        w, fill = self._new(), 0
                    part = ids[: self.size - fill]
                    out.append((doc, start, part, total, w, fill))
                    fill, start, ids = fill + len(part), start + len(part), ids[len(part) :]
        self.__init__(self.size)
        return out


_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def _pack(window: int, dtype: str):
    def rows(lane: int, pieces: list[tuple]) -> pa.RecordBatch:
        cols = {n: [] for n in _PIECE.names}
        for doc, start, ids, total, w, offset in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            for n, v in zip(cols, (doc, start, len(ids), crc, total, (lane << 32) + w, offset)):
                cols[n].append(v)
        return pa.RecordBatch.from_pydict(cols, schema=_PIECE)

    def run(batches):
        lane, packer, held = None, SumOfSquares(window), []
        for b in batches:
            for at, doc, ids in zip(b.column("lane").to_pylist(), b.column("id").to_pylist(), b.column("ids")):
                if at != lane:
                    yield rows(lane or 0, held + packer.finish())
                    lane, held, packer = at, [], SumOfSquares(window)
                held += packer.place(doc, np.frombuffer(ids.as_py(), dtype))
                if len(held) > 5000:
                    yield rows(lane, held)
                    held = []
        yield rows(lane or 0, held + packer.finish())

    return run


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, lane_docs: int = LANE_DOCS) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset); a
    sequence id is its lane and its number in the lane."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    lanes = max(1, -(-src.count() // lane_docs))
    ids = src.mapInArrow(_tokenise(path), "id long, ids binary")
    ids = ids.withColumn("o", F.xxhash64("id", "ids")).withColumn("lane", F.pmod("o", F.lit(lanes)).cast("long"))
    dealt = ids.repartition("lane").sortWithinPartitions("lane", "o", "id").select("lane", "id", "ids")
    return dealt.mapInArrow(_pack(window, tokenizer(path).dtype), ", ".join(f"{n} long" for n in _PIECE.names))
