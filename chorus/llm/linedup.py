"""Line de-duplication over overlapping three-line windows.

A window is three consecutive lines (split at ``\\n``, compared without white space at
either end); windows of blank lines only are left out.  Windows are compared by a
128-bit hash over the whole corpus.  The occurrence with the smallest (doc_id, line) is
the first one; every line covered by a later occurrence is removed.

Defined results: a null text stays null; fewer than three lines have no window and stay
as they are; rows that share doc_id and text are one document given twice and get the
same result (neither is later than the other); a null doc_id comes before all others.

Passages (``passages=True``, used by the pipeline; the SQL below has none): a passage that
stands on one or two lines fills no window of three.  So runs of ``RUN`` consecutive words
(at ASCII white space, whatever the line breaks) are compared as well: of every ``PICK``
neighbouring runs the one with the smallest hash, and those at the first and last word of
one or two long lines.  Copies of ``RUN + PICK - 1`` = 50 words always share a picked run.
Every word in a later occurrence is removed, and a line of which no word is left.  What
stays: copies under ``RUN`` words, some of ``RUN`` to 49, and up to ``PICK - 1`` words at an
end of a passage that lies inside a line.

Scale: windows travel as (doc_id, text hash, line, two longs).  First occurrences are a
partially aggregated minimum, so a window that occurs everywhere costs one row per task,
and the join back is between two plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import own
from chorus.llm.minhash import _hashes

WINDOW = 3
RUN = 34  # words
PICK = 17
PASSAGE = 1 << 30  # added to the position of a run; a text has fewer lines and words
_SLICE = 1 << 16
_P = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[^ \t-\r]+")
_WIN = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])


def _line_windows(lines: list[bytes]):
    """(position, content) of every non-blank window."""
    lines = [x.strip() for x in lines]
    for p in range(len(lines) - WINDOW + 1):
        w = lines[p : p + WINDOW]
        if any(w):
            yield p, b"\n".join(w)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    s = (a * _P ^ b) * _P
    return s ^ (s >> np.uint64(29))


def _runs(lines: list[bytes]):
    """(position, content) of the picked runs of words; the content is the word hashes."""
    parts = [x.split() for x in lines]
    size = np.array([len(x) for x in parts])
    n = int(size.sum())
    if n < RUN:
        return
    h = np.fromiter((_hashes[w] for x in parts for w in x), np.uint64, n)
    s, width = h, 1
    while 2 * width <= RUN:
        s, width = _mix(s[:-width], s[width:]), 2 * width
    s = _mix(s[: n - RUN + 1], s[RUN - width :])  # overlapping halves cover the run
    pick = min(PICK, len(s))
    view = np.lib.stride_tricks.sliding_window_view(s, pick)
    at = [np.unique(view[i : i + _SLICE].argmin(axis=1) + np.arange(i, min(i + _SLICE, len(view)))) for i in range(0, len(view), _SLICE)]
    # whole lines: runs from the first word and up to the last of one or two long lines
    size = size[size > 0]
    end = np.cumsum(size)
    two = np.append(size[:-1] + size[1:] >= RUN + PICK - 1, False)
    at.append((end - size)[(size >= RUN) | two])
    at.append(end[(size >= RUN) | np.roll(two, 1)] - RUN)
    at = np.unique(np.concatenate(at))
    for p in at[(at >= 0) & (at <= n - RUN)].tolist():
        yield PASSAGE + p, b"run" + h[p : p + RUN].tobytes()


def _windows(passages: bool):
    """Every non-blank window, and picked run if asked, of whole texts."""

    def run(batches):
        for b in batches:
            cols = {f.name: [] for f in _WIN}
            texts = b.column(2).cast(pa.binary())
            for i, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts):
                lines = text.as_py().split(b"\n")
                for found in (_line_windows, _runs)[: 1 + passages]:
                    for p, content in found(lines):
                        h = xxhash.xxh3_128_digest(content)
                        cols["id"].append(i)
                        cols["th"].append(th)
                        cols["pos"].append(p)
                        cols["h1"].append(int.from_bytes(h[:8], "little", signed=True))
                        cols["h2"].append(int.from_bytes(h[8:], "little", signed=True))
                if len(cols["pos"]) >= 20000:
                    yield pa.RecordBatch.from_pydict(cols, schema=_WIN)
                    cols = {f.name: [] for f in _WIN}
            yield pa.RecordBatch.from_pydict(cols, schema=_WIN)

    return run


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """(id, th, starts): per document, the line numbers at which a later occurrence of a
    window starts (and ``PASSAGE`` + word numbers of runs); ``th`` is the xxhash64 of the text."""
    src = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t")
    )
    if not passages:
        src = src.where(F.col("t").contains("\n"))
    win = src.mapInArrow(_windows(passages), "id long, th long, pos int, h1 long, h2 long")
    first = (
        win.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("first"))
        .where("n > 1")
        .select(own("h1").alias("g1"), own("h2").alias("g2"), "first")
    )
    later = win.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).where(
        ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos")))
    )
    return later.groupBy("id", "th").agg(F.collect_set("pos").alias("starts"))


def _without(lines: list[str], gone: set[int], runs: list[int]) -> dict[int, str | None]:
    """The lines that lose words of the runs, as they are then; None for those that go."""
    raw = [x.encode() for x in lines]
    size = [len(x.split()) for x in raw]
    drop = np.zeros(sum(size), bool)
    for p in runs:
        drop[p : p + RUN] = True
    out, first = {}, 0
    for i, n in enumerate(size):
        d = drop[first : first + n]
        first += n
        if i in gone or not d.any():
            continue
        if d.all():
            out[i] = None
            continue
        spans = [m.span() for m in _WORD.finditer(raw[i])]
        kept, at = [], 0
        for k, (x, y) in enumerate(spans):
            if d[k]:  # goes with the white space before it, at the start of a line with that behind it
                if k == 0:
                    kept.append(raw[i][:x])
                at = spans[k + 1][0] if k + 1 < n and d[: k + 1].all() else y
            else:
                kept.append(raw[i][at:y])
                at = y
        out[i] = b"".join([*kept, raw[i][at:]]).decode()
    return out


def _remove(batches):
    for b in batches:
        text, dropped, lines_n = [], [], []
        for t, starts in zip(b.column("_t").to_pylist(), b.column("_starts").to_pylist()):
            if t is None:
                text.append(None), dropped.append(0), lines_n.append(0)
                continue
            lines = t.split("\n")
            gone = {p + k for p in starts or () if p < PASSAGE for k in range(WINDOW)}
            runs = [p - PASSAGE for p in starts or () if p >= PASSAGE]
            changed = _without(lines, gone, runs) if runs else {}
            gone.update(i for i, x in changed.items() if x is None)
            text.append("\n".join(changed.get(i, x) for i, x in enumerate(lines) if i not in gone) if starts else t)
            dropped.append(len(gone)), lines_n.append(len(lines))
        keep = [n for n in b.schema.names if n not in ("_t", "_starts")]
        arrays = [b.column(n) for n in keep]
        yield pa.RecordBatch.from_arrays(
            [*arrays, pa.array(text, pa.string()), pa.array(lines_n, pa.int64()), pa.array(dropped, pa.int64())],
            names=[*keep, "_text", "_lines", "_dropped"],
        )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """``docs`` with the text cleaned, plus ``n_lines`` (before) and ``n_removed`` (whole
    lines).  Columns of those two names in the input are replaced; all others pass through."""
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    cols = {c: f"_c{i}" for i, c in enumerate(rest)}
    left = docs.select(
        *[F.col(f"`{c}`").alias(a) for c, a in cols.items()],
        F.col(id_col).cast("long").alias("_i"),
        F.xxhash64(text_col).alias("_h"),
        F.col(text_col).alias("_t"),
    )
    rep = repeated_windows(docs, id_col, text_col, passages).select(
        "id", F.col("th").alias("_th"), F.col("starts").alias("_starts")
    )
    joined = left.join(rep, F.col("_i").eqNullSafe(F.col("id")) & (F.col("_h") == F.col("_th")), "left")
    joined = joined.select(*cols.values(), "_t", "_starts")
    types = dict(docs.select(*[F.col(f"`{c}`").alias(a) for c, a in cols.items()]).dtypes)
    schema = ", ".join([f"`{a}` {types[a]}" for a in cols.values()] + ["_text string, _lines long, _dropped long"])
    out = joined.mapInArrow(_remove, schema)
    named = [F.col("_text" if c == text_col else cols[c]).alias(c) for c in docs.columns if c == text_col or c in cols]
    return out.select(*named, F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_removed"))


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i - 1 AS pos, trim(a[i], E' \\t\\r\\x0b\\x0c') AS x, trim(a[i + 1], E' \\t\\r\\x0b\\x0c') AS y,
             trim(a[i + 2], E' \\t\\r\\x0b\\x0c') AS z
      FROM (SELECT doc_id, a, unnest(range(1, len(a) - 1)) AS i FROM l)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) AS k FROM w
      WHERE x <> '' OR y <> '' OR z <> ''),
g AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM r WHERE k > 1) GROUP BY 1)
SELECT d.doc_id, CASE WHEN g.gone IS NULL THEN d.text
            ELSE array_to_string([a[i + 1] FOR i IN range(0, len(a)) IF NOT list_contains(g.gone, i)], chr(10)) END AS text,
       COALESCE(len(a), 0)::BIGINT AS n_lines, COALESCE(len(g.gone), 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""
