"""Information-theoretic sanitisation of personal data.

Protected entities are the e-mail addresses, IP addresses, card and phone numbers that
fixed patterns find.  A term reveals an entity c as far as its pointwise mutual
information with c approaches the information content of c:

    disclosure(t, c) = PMI(t; c) / IC(c) = 1 + log2(n(t, c) / n(t)) / log2(N / m(c))

n(t) counts t over all words of all texts (N words), n(t, c) those within ``REACH`` words
(and 40 characters a word) of c on the same line, m(c) all words near c.  A term near c in at least ``SUPPORT``
different windows (so copies of one passage count once) is generalised to a class mark
from ``GENERALISE`` on, and removed from ``REMOVE`` on, wherever it stands near c.

Defined results: a null text counts as empty; empty texts have no spans; rows that repeat
doc_id and text get the same spans; a null doc_id is kept as null; other columns pass.

Scale: texts are read twice (patterns; word counts, summed per batch before the shuffle);
only words near entities become rows, and they are counted in two steps, first with the
window in the key, so that a very common entity is spread over all tasks.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import cut, own

KINDS = ("email", "ip", "card", "phone", "term")
REACH = 8
SUPPORT = 3
GENERALISE, REMOVE = 0.95, 0.99
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str):
    """Spans of the e-mail pattern; each run before an @ is looked at once."""
    end, last, at = 0, 0, text.find("@")
    while at >= 0:
        run = text[max(end, last) : at]
        local = len(run) - len(run.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if local else None
        if m:
            yield at - local, m.end()
            end = m.end()
        last = at + 1
        at = text.find("@", max(end, last))


def _luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, by start and then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _entity(text: str, span: tuple[int, int, int]) -> int:
    value = text[span[0] : span[2]]
    value = value.lower() if span[1] == 0 else value if span[1] == 1 else _NO_DIGIT.sub("", value)
    return _signed(f"{span[1]}:{value}".encode())


def _signed(b: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(b)
    return h - (1 << 64) if h >> 63 else h


def _near(text: str, spans: list[tuple[int, int, int]]) -> list[tuple]:
    """(entity, window hash, term, start, end) for the words within reach of each span."""
    covered = [(a, b) for a, _, b in spans]
    seen: dict[tuple, tuple] = {}
    for span in spans:
        a, _, b = span
        lo = text.rfind("\n", 0, a) + 1
        hi = text.find("\n", b)
        hi = len(text) if hi < 0 else hi
        # at most 40 characters a word; a word cut off there is left out
        lo2, hi2 = max(lo, a - 40 * REACH), min(hi, b + 40 * REACH)
        words = [m for m in _TERM.finditer(text, lo2, a) if m.start() > lo2 or lo2 == lo][-REACH:]
        words += [m for m in _TERM.finditer(text, b, hi2) if m.end() < hi2 or hi2 == hi][:REACH]
        words = [m for m in words if not any(m.start() < y and m.end() > x for x, y in covered)]
        window = _signed(" ".join(m[0].lower() for m in words).encode("utf-8", "surrogatepass"))
        c = _entity(text, span)
        for m in words:
            seen.setdefault((c, m.start()), (c, window, m[0].lower(), m.start(), m.end()))
    return list(seen.values())


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_CTX = pa.list_(pa.struct([("entity", pa.int64()), ("win", pa.int64()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _detect(batches):
    for b in batches:
        spans, near = [], []
        for t in b.column(2).to_pylist():
            s = base_spans(t or "")
            spans.append([dict(zip(("start", "kind", "end"), x)) for x in s])
            near.append([dict(zip(("entity", "win", "term", "start", "end"), x)) for x in _near(t, s)] if s else [])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, _SPAN), pa.array(near, _CTX)], names=["id", "th", "spans", "near"])


def _count_words(batches):
    """Words of whole texts outside the fixed patterns, summed per some millions of
    characters; "" counts all."""
    n, size = Counter(), 0
    for b in batches:
        for t in b.column(0).to_pylist():
            size += len(t)
            parts, end = [], 0
            for start, _, stop in base_spans(t):
                parts.append(t[end : max(start, end)])
                end = max(end, stop)
            words = _TERM.findall(" ".join([*parts, t[end:]]).lower())
            n.update(words)
            n[""] += len(words)
            if size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values()), pa.int64())], names=["term", "n"])
                n, size = Counter(), 0
    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])


def disclosing_terms(found: DataFrame, texts: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(entity, term, disclosure) of the terms near an entity in ``support`` windows."""
    near = found.select(F.explode("near").alias("x")).select("x.*")
    step = near.groupBy("entity", "term", "win").agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(step.groupBy("entity", "term").agg(F.sum("n").alias("n_tc"), F.count(F.lit(1)).alias("windows")).where(F.col("windows") >= support))
    near_c = near.groupBy("entity").agg(F.count(F.lit(1)).alias("m_c"))
    total = texts.mapInArrow(_count_words, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    wanted = pairs.select("term").distinct().unionByName(pairs.sparkSession.createDataFrame([("",)], "term string"))
    total = cut(total.join(wanted, "term"))
    words = total.where("term = ''").agg(F.max("n_t")).first()[0] or 0
    share = 1 + F.log2(F.col("n_tc") / F.col("n_t")) / F.log2(F.lit(float(words)) / F.col("m_c"))
    return (
        pairs.join(near_c.select(own("entity").alias("e"), "m_c"), F.col("entity") == F.col("e"))
        .join(total, "term")
        .select("entity", "term", F.when(F.col("m_c") < words, share).alias("disclosure"))
    )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """(id, th, base, terms): per row the base spans (start, kind, end) and the spans of
    disclosing terms (start, kind, end, disclosure); ``th`` is the xxhash64 of the text."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    found = cut(src.mapInArrow(
        _detect,
        "id long, th long, spans array<struct<start:int,kind:int,end:int>>, "
        "near array<struct<entity:long,win:long,term:string,start:int,end:int>>",
    ))
    texts = src.where(F.length("t") > 2).select("t")
    flagged = disclosing_terms(found, texts, support).where(F.col("disclosure") >= generalise)
    flagged = flagged.select(own("entity").alias("e"), F.col("term").alias("w"), "disclosure")
    near = found.select("id", "th", F.explode("near").alias("x")).select("id", "th", "x.*")
    spans = (
        near.join(flagged, (F.col("entity") == F.col("e")) & (F.col("term") == F.col("w")))
        .groupBy("id", "th", "start", "end").agg(F.max("disclosure").alias("disclosure"))
        .groupBy("id", "th")
        .agg(F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "disclosure"))).alias("terms"))
        .select(F.col("id").alias("i2"), own("th").alias("th2"), "terms")
    )
    out = found.join(spans, F.col("id").eqNullSafe(F.col("i2")) & (F.col("th") == F.col("th2")), "left")
    return out.select("id", "th", F.col("spans").alias("base"), F.coalesce("terms", F.expr("array()")).alias("terms"))


def report(found: DataFrame) -> DataFrame:
    """Counts and span strings of ``find``'s rows."""
    kinds = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, one), ",")

    plain = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    every = F.array_sort(F.concat("base", plain))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "id", *[count(k) for k in range(4)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(every).alias("spans"), F.size("terms").cast("long").alias("n_term"),
    )


def _sanitised(text: str, spans: list[tuple[int, int, int, float]], remove: float) -> str:
    """Spans replaced by marks; of overlapping spans the union becomes the first's mark."""
    out, end = [], 0
    for start, kind, stop, share in sorted(spans):
        if start >= end:
            if kind < 4:
                mark = MARKS[KINDS[kind]]
            else:
                mark = "" if share >= remove else "[NAME]" if text[start].isupper() else "[WORD]"
            out += text[end:start], mark
        end = max(end, stop)
    return "".join(out) + text[end:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with personal data masked and disclosing terms generalised or removed."""
    found = find(docs, id_col, text_col, generalise, support).where((F.size("base") > 0) | (F.size("terms") > 0))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(0.0).alias("disclosure")))
    found = found.select(F.col("id").alias("_i"), own("th").alias("_h"), F.concat(base, "terms").alias("_spans")).dropDuplicates(["_i", "_h"])
    cols = [f"_c{i}" for i in range(len(docs.columns))]
    inner = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, cols)])
    text_at, id_at = docs.columns.index(text_col), docs.columns.index(id_col)
    joined = inner.join(found, F.col(cols[id_at]).cast("long").eqNullSafe(F.col("_i")) & (F.xxhash64(cols[text_at]) == F.col("_h")), "left")

    def run(batches):
        for b in batches:
            texts = b.column(text_at).to_pylist()
            for i, s in enumerate(b.column(len(cols)).to_pylist()):
                if s and texts[i] is not None:
                    texts[i] = _sanitised(texts[i], [tuple(x.values()) for x in s], remove)
            arrays = list(b.columns[: len(cols)])
            arrays[text_at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    schema = ", ".join(f"{c} {t}" for c, t in inner.dtypes)
    return joined.select(*cols, "_spans").mapInArrow(run, schema).toDF(*docs.columns)
