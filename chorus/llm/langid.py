"""Language identification by interpolated Kneser-Ney character models.

One model per language over letters in lower case, with every run of other characters
read as one space.  Spark counts the highest-order n-grams of all training texts; lower
orders are continuation counts, which follow from the distinct n-grams.  All orders are
kept as arrays sorted by n-gram hash, with one log-probability column per language, so a
text is looked up once for all languages.  The language with the lowest cross-entropy per
character wins; a text whose cross-entropy lies ``Z_MAX`` deviations above what texts of
its language and length have is marked as rejected.

Bounds: of each language and order the n-grams with the highest counts are kept, about
``MAX_GRAMS``, and the ends of kept longer ones - this is the size of the broadcast; no language
takes room from another.  Counts, continuation counts, context totals, discounts and the
alphabet are those of every training text, before anything is dropped; what a context loses
goes to its back-off weight, so its probabilities still add up to 1.  Calibration scores
every training text; Spark finds each language's 0.99 quantile by exact positions and sums
the rest, so a few numbers a language reach the driver.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is
rejected; without any labelled text every document is ``und``; a null doc_id is neither
learned from nor held out; a language label that is null teaches nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.llm.common import cut
from chorus.operators.ranking import position_within

ORDER = 4
MAX_GRAMS = 500_000
Z_MAX = 6.0
SCORE_CHARS = 50  # evidence counted for the score, so that it is not simply 0 or 1
GROUP_CHARS = 250_000
COUNT_CHARS = 1_000_000
PAD = 2
_P = np.uint64(0x9E3779B97F4A7C15)

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """True for code points that are letters; built once per process."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the texts behind ``order - 1`` pads each, the text each belongs to, and
    whether it is a character (not a pad)."""
    pad = PAD.to_bytes(4, "little") * (order - 1)
    coded = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    a = np.frombuffer(b"".join(x for c in coded for x in (pad, c)), "<u4")
    size = np.array([len(c) // 4 + order - 1 for c in coded])
    start = np.cumsum(size) - size
    is_pad = np.zeros(len(a), bool)
    for k in range(order - 1):
        is_pad[start + k] = True
    letter = _is_letter()[a] & ~is_pad
    keep = letter | is_pad
    keep[1:] |= letter[:-1]  # the first character after a word stands for the gap
    sym = np.where(letter, a, np.where(is_pad, PAD, 32))[keep]
    return sym.astype(np.uint64), np.repeat(np.arange(len(texts)), size)[keep], ~is_pad[keep]


def keys(sym: np.ndarray, order: int) -> list[np.ndarray]:
    """keys[n - 1][i]: hash of the n symbols that end at i."""
    out = [sym]
    for _ in range(1, order):
        k = np.empty_like(sym)
        k[0] = 0
        k[1:] = out[-1][:-1] * _P
        out.append(k + sym)
    return out


def text_groups(texts: list[str], chars: int = GROUP_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first, texts) in groups of bounded size; a longer text stands alone."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > chars:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


NOTHING = pd.DataFrame({"lang_pred": [], "score": [], "cross_entropy": [], "rejected": []})
_COUNT = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("c", pa.int64())])


def _count(order: int):
    """Counts of the highest-order n-grams by language, pre-aggregated per group of texts."""

    def run(batches):
        for b in batches:
            t = pd.DataFrame({"lang": b.column(0).to_pylist(), "text": b.column(1).to_pylist()})
            for lang, part in t.groupby("lang", sort=True):
                for _, group in text_groups(part["text"].tolist(), COUNT_CHARS):
                    sym, _, real = symbols(group, order)
                    at = np.flatnonzero(real)
                    if not len(at):
                        continue
                    _, first, n = np.unique(keys(sym, order)[-1][at], return_index=True, return_counts=True)
                    at = at[first]
                    codes = np.stack([sym[at - order + 1 + k] for k in range(order)], 1).astype("<u4")
                    grams = codes.tobytes().decode("utf-32-le", "surrogatepass")
                    grams = [grams[i : i + order] for i in range(0, len(grams), order)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(n)], schema=_COUNT)

    return run


def _hash(grams: list[str]) -> np.ndarray:
    n = len(grams[0]) if grams else 1
    codes = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)
    k = codes[:, 0]
    for j in range(1, n):
        k = k * _P + codes[:, j]
    return k


def _tables(counts: pd.DataFrame, order: int) -> tuple[list[pd.DataFrame], pd.DataFrame, int]:
    """What ``Model.of`` takes, of small counts that are kept whole."""
    kept, stats = [], []
    c = counts[["lang", "gram", "c"]]
    for n in range(order, 0, -1):
        if n < order:
            c = c.assign(gram=c["gram"].str[1:]).groupby(["lang", "gram"], as_index=False).agg(c=("c", "size"))
            c = c[c["gram"] != chr(PAD) * n]
        total = c.groupby(["lang", c["gram"].str[:-1]])["c"].transform("sum")
        kept.insert(0, c.assign(total=total))
        for lang, x in c.groupby("lang")["c"]:
            stats.append((lang, n, int((x == 1).sum()), int((x == 2).sum())))
    return kept, pd.DataFrame(stats, columns=["lang", "n", "n1", "n2"]), kept[0]["gram"].nunique() + 1


def _gather(grams: DataFrame, order: int, most: int) -> tuple[list[pd.DataFrame], pd.DataFrame, int] | None:
    """What ``Model.of`` takes, by Spark; only the kept n-grams and sums reach the driver."""
    spark = grams.sparkSession
    kept, stats, above, table, vocab = [], [], None, grams, 1
    for n in range(order, 0, -1):
        if n < order:  # continuation counts: distinct symbols before
            table = table.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
            table = cut(table.where(F.col("gram") != chr(PAD) * n))
        # numbers of n-grams by count: those above ``least`` fit, of those at it a share, by hash
        size = table.groupBy("lang", F.least("c", F.lit(most)).alias("c")).agg(F.count(F.lit(1)).alias("k")).toPandas()
        if size.empty:
            return None
        least = []
        for lang, x in size.sort_values("c", ascending=False).groupby("lang"):
            by, upto = dict(zip(x["c"], x["k"])), x["k"].cumsum().to_numpy()
            at = min(int((upto <= most).sum()), len(x) - 1)
            share = (most - (upto[at] - x["k"].iat[at])) / x["k"].iat[at]
            least.append((lang, int(x["c"].iat[at]), min(1.0, float(share))))
            stats.append((lang, n, by.get(1, 0), by.get(2, 0)))
        bound = F.broadcast(spark.createDataFrame(least, "lang string, least long, share double"))
        high = (F.least("c", F.lit(most)) > F.col("least")) | (
            (F.least("c", F.lit(most)) == F.col("least")) & (F.pmod(F.xxhash64("gram"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
        )
        row = table.join(bound.withColumnRenamed("lang", "l"), F.col("lang") == F.col("l")).withColumn("high", high)
        if above is None:
            row = row.where("high")
        else:
            ends = above.select("lang", F.substring("gram", 2, n).alias("gram"), F.lit(True).alias("end")).distinct()
            row = row.join(ends, ["lang", "gram"], "left").where("high OR end")
        row = row.select("lang", "gram", "c", F.substring("gram", 1, n - 1).alias("ctx"))
        total = table.groupBy("lang", F.substring("gram", 1, n - 1).alias("ctx")).agg(F.sum("c").alias("total"))
        above = cut(row.join(total, ["lang", "ctx"]).select("lang", "gram", "c", "total"))
        kept.insert(0, above.toPandas())
        if n == 1:
            vocab = table.select("gram").distinct().count() + 1
    return kept, pd.DataFrame(stats, columns=["lang", "n", "n1", "n2"]), vocab


class Model:
    """Sorted hash arrays: per order the log-probability of each n-gram and the log-weight
    of each context, one column per language."""

    def __init__(self, counts: pd.DataFrame, order: int):
        """From the counts (lang, gram, c) of all highest-order n-grams."""
        self._build(*_tables(counts, order), order)

    @classmethod
    def of(cls, kept: list[pd.DataFrame], stats: pd.DataFrame, vocab: int, order: int) -> Model:
        """From kept n-grams by order (lang, gram, c, total of the context) and the numbers n1
        and n2 of n-grams seen once and twice by language and order n."""
        model = cls.__new__(cls)
        model._build(kept, stats, vocab, order)
        return model

    def _build(self, kept: list[pd.DataFrame], stats: pd.DataFrame, vocab: int, order: int) -> None:
        self.order = order
        self.langs = sorted(stats["lang"].unique())
        width = len(self.langs)
        discount = {(r.lang, r.n): r.n1 / (r.n1 + 2 * r.n2) if r.n1 and r.n2 else 0.5 for r in stats.itertuples()}
        by_order = [None, *({lang: k[k["lang"] == lang].set_index("gram").sort_index() for lang in self.langs} for k in kept)]
        self.floor = np.zeros(width, np.float32)
        self.gram: list[tuple[np.ndarray, np.ndarray]] = []
        self.context: list[tuple[np.ndarray, np.ndarray]] = []
        lower = None
        for n in range(1, order + 1):
            union = pd.Index(sorted(set().union(*[by_order[n][x].index for x in self.langs])))
            ctx_union = pd.Index(sorted(set(union.str[:-1])))
            prob = np.zeros((len(union), width))
            weight = np.ones((len(ctx_union), width))
            for k, lang in enumerate(self.langs):
                t, d = by_order[n][lang], discount[lang, n]
                p = (t["c"] - d) / t["total"]
                prob[union.get_indexer(t.index), k] = p.to_numpy()
                # what the kept n-grams of a context leave; d * types / total where all are kept
                lam = np.maximum(1 - p.groupby(t.index.str[:-1]).sum(), 1e-12)
                weight[ctx_union.get_indexer(lam.index), k] = lam.to_numpy()
            back = weight[ctx_union.get_indexer(union.str[:-1])]
            if n == 1:
                prob = prob + back / vocab
                self.floor = np.log(weight[0] / vocab).astype(np.float32)
            else:
                below = np.exp(self.floor)[None, :].repeat(len(union), 0).astype(float)
                at = lower[0].get_indexer(union.str[1:])
                below[at >= 0] = lower[1][at[at >= 0]]
                prob = prob + back * below
                self.context.append(self._sorted(_hash(list(ctx_union)), np.log(weight)))
            lower = (union, prob)
            self.gram.append(self._sorted(_hash(list(union)), np.log(prob)))
        self.mean = np.zeros(width)
        self.spread = np.ones((width, 2))

    @staticmethod
    def _sorted(k: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        o = np.argsort(k)
        return k[o], v[o].astype(np.float32)

    @staticmethod
    def _find(table, k):
        at = np.searchsorted(table[0], k)
        at[at == len(table[0])] = 0
        return at, table[0][at] == k

    def log_prob(self, sym: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Log-probability of every real symbol after those before it, by language."""
        ks = keys(sym, self.order)
        at = np.flatnonzero(real)
        out = np.zeros((len(at), len(self.langs)), np.float32)
        todo = np.arange(len(at))
        for n in range(self.order, 0, -1):
            i, hit = self._find(self.gram[n - 1], ks[n - 1][at[todo]])
            out[todo[hit]] += self.gram[n - 1][1][i[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
            if n == 1:
                out[todo] += self.floor
            else:
                i, hit = self._find(self.context[n - 2], ks[n - 2][at[todo] - 1])
                out[todo[hit]] += self.context[n - 2][1][i[hit]]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per character by language, characters) of each text."""
        sym, doc, real = symbols(texts, self.order)
        lp = self.log_prob(sym, real)
        doc = doc[real]
        n = np.bincount(doc, minlength=len(texts))
        total = np.stack([np.bincount(doc, lp[:, k], minlength=len(texts)) for k in range(len(self.langs))], 1)
        return -total / np.maximum(n, 1)[:, None], n

    def calibrate(self, scored: DataFrame) -> None:
        """Mean and spread (between texts, per character) of the cross-entropy by language,
        from (lang, h, n) of all training texts; the highest hundredth of each is left out."""
        self.spread[:] = (1.0, 4.0)
        size = {r["lang"]: r["k"] for r in scored.groupBy("lang").agg(F.count(F.lit(1)).alias("k")).collect()}
        if not size:
            return
        at = F.create_map(*[F.lit(x) for lang, k in size.items() for x in (lang, int((k - 1) * 0.99))])
        placed = position_within(scored, ["lang"], ["h", "n"], out="_pos")
        upto = {r["lang"]: r["h"] for r in placed.where(F.col("_pos") == at[F.col("lang")]).collect()}
        kept = scored.where(F.col("h") <= F.create_map(*[F.lit(x) for p in upto.items() for x in p])[F.col("lang")])
        mean = {r["lang"]: r["m"] for r in kept.groupBy("lang").agg((F.sum(F.col("h") * F.col("n")) / F.sum("n")).alias("m")).collect()}
        u, r = 1 / F.col("n"), (F.col("h") - F.create_map(*[F.lit(x) for p in mean.items() for x in p])[F.col("lang")]) ** 2
        sums = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("k"), *[F.sum(c).alias(f) for c, f in ((u, "u"), (u * u, "uu"), (r, "r"), (r * u, "ru"))])
        for x in sums.collect():  # least squares of the squared deviation on 1 and 1 / n
            i = self.langs.index(x["lang"])
            fit = np.linalg.lstsq(np.array([[x["k"], x["u"]], [x["u"], x["uu"]]]), np.array([x["r"], x["ru"]]), rcond=None)[0]
            self.mean[i] = mean[x["lang"]]
            self.spread[i] = max(fit[0], 0.01), max(fit[1], 1.0)

    def decide(self, texts: list[str]) -> pd.DataFrame:
        """lang_pred, score, cross_entropy and rejected of each text."""
        h, n = self.entropies(texts)
        best = h.argmin(1)
        low = h[np.arange(len(h)), best]
        e = np.exp(-(h - low[:, None]) * np.minimum(n, SCORE_CHARS)[:, None])
        limit = self.mean[best] + Z_MAX * np.sqrt(self.spread[best, 0] + self.spread[best, 1] / np.maximum(n, 1))
        none = n == 0
        return pd.DataFrame({
            "lang_pred": np.where(none, "und", np.array(self.langs, object)[best]),
            "score": np.where(none, 0.0, 1 / e.sum(1)),
            "cross_entropy": np.where(none, np.nan, low),
            "rejected": none | (low > limit),
        })


def held_out(id_col: str = "doc_id"):
    """True where crc32(id as text) mod 3 is 1; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> Model | None:
    """Model of the labelled documents that are not held out; None if there are none."""
    train = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    train = train.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    grams = train.mapInArrow(_count(order), "lang string, gram string, c long")
    grams = cut(grams.groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    gathered = _gather(grams, order, MAX_GRAMS)
    if gathered is None:
        return None
    model = Model.of(*gathered, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        place = {lang: k for k, lang in enumerate(m.langs)}
        for b in batches:
            texts, lang = b.column(1).to_pylist(), b.column(0).to_pylist()
            for first, group in text_groups(texts):
                h, n = m.entropies(group)
                at = np.flatnonzero(n)
                own = [lang[first + i] for i in at]
                cols = [pa.array(own, pa.string()), pa.array(h[at, [place[x] for x in own]], pa.float64()), pa.array(n[at], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["lang", "h", "n"])

    model.calibrate(cut(train.mapInArrow(run, "lang string, h double, n long")))
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep_rejected: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected (columns of these names
    are replaced); without the rejected documents if asked."""
    new = ["lang_pred", "score", "cross_entropy", "rejected"]
    base = docs.drop(*new)
    cols = [f"_c{i}" for i in range(len(base.columns))]
    inner = base.toDF(*cols)
    text_at = base.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(text_at).to_pylist()]
            if m is None:
                d = pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "cross_entropy": np.nan, "rejected": True})
            else:
                d = pd.concat([m.decide(g) for _, g in text_groups(texts)] or [NOTHING], ignore_index=True)
            out = pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(d["lang_pred"], pa.string()), pa.array(d["score"], pa.float64()),
                 pa.array(d["cross_entropy"], pa.float64()), pa.array(d["rejected"], pa.bool_())],
                names=[*cols, *new],
            )
            yield out if keep_rejected else out.filter(pa.array(~d["rejected"].to_numpy(bool)))

    schema = ", ".join([f"{c} {t}" for c, t in inner.dtypes] + ["lang_pred string, score double, cross_entropy double, rejected boolean"])
    return inner.mapInArrow(run, schema).toDF(*base.columns, *new)

