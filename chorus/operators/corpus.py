"""Corpus statistics: token counts, document frequencies, vocabularies, per-key term
tables, stop-word removal and dictionary lemmatisation.

Token streams are exploded once and aggregated with map-side partial aggregation
at the finest key (``key, term``) before anything is widened to report dimensions.
The vocabulary is capped (top ``max_features`` terms), so it is a bounded table that
can be broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.functions import text as tx
from chorus.operators.ranking import top_n_per_key
from chorus.session import checkpoint_dir


def explode_tokens(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per token occurrence: (*keep, term)."""
    return df.select(*keep, F.explode(tx.tokenise(text)).alias("term"))


def _term_hits(text: str) -> Column:
    """Per document: one (term, 1, 0) entry per token and one (term, 0, 1) entry per
    distinct token.  Summing them gives occurrences and document frequency in a single
    partial aggregation - no distinct-aggregate shuffle on (key, term, doc).  The token
    array is bound once through a one-element lambda so the regex runs once."""

    def hits(ts: Column) -> Column:
        occ = F.transform(ts, lambda t: F.struct(t.alias("term"), F.lit(1).alias("_o"), F.lit(0).alias("_d")))
        first = F.transform(F.array_distinct(ts), lambda t: F.struct(t.alias("term"), F.lit(0).alias("_o"), F.lit(1).alias("_d")))
        return F.concat(occ, first)

    return F.element_at(F.transform(F.array(tx.tokenise(text)), hits), 1)


def key_term_counts(df: DataFrame, text: str, key: str, id_col: str | None = None) -> DataFrame:
    """(key, term, n, df): occurrences and number of distinct documents per key and term.

    A document belongs to one key, so document frequencies add up across keys.
    """
    ex = df.select(key, F.inline(_term_hits(text)))
    return ex.groupBy(key, "term").agg(F.sum("_o").cast("long").alias("n"), F.sum("_d").cast("long").alias("df"))


def vocabulary(
    term_stats: DataFrame,
    n_docs: Column | int | None = None,
    min_df: int = 2,
    max_df: float = 1.0,
    max_features: int | None = 1000,
    stop_words: Iterable[str] | DataFrame | None = None,
) -> DataFrame:
    """(term, n, df) of the kept vocabulary, like the reference vectoriser.

    ``min_df`` is a document count; ``max_df`` a fraction of ``n_docs`` (1.0 = no bound).
    The cap keeps the ``max_features`` most frequent terms (ties: term ascending) and
    stop words are removed *after* the cap, so fewer terms can remain.
    """
    per_term = term_stats.groupBy("term").agg(F.sum("n").cast("long").alias("n"), F.sum("df").cast("long").alias("df"))
    kept = per_term.filter(F.col("df") >= min_df)
    if max_df < 1.0 and n_docs is not None:
        bound = (n_docs if isinstance(n_docs, Column) else F.lit(n_docs)) * F.lit(max_df)
        kept = kept.filter(F.col("df") <= bound)
    if max_features is not None:
        kept = kept.orderBy(F.desc("n"), F.asc("term")).limit(max_features)
    if stop_words is not None:
        if isinstance(stop_words, DataFrame):
            kept = kept.join(stop_words.select(F.col(stop_words.columns[0]).alias("term")), "term", "left_anti")
        else:
            kept = kept.filter(~F.col("term").isin(*list(stop_words)))
    return kept


def term_frequencies(df: DataFrame, text: str, id_col: str, stop_words: Iterable[str] | None = None, max_features: int | None = 1000, min_df: int = 2) -> DataFrame:
    """(term, n, df) of the corpus vocabulary; order at the sink by n desc, term asc."""
    ex = df.select(F.inline(_term_hits(text)))
    stats = ex.groupBy("term").agg(F.sum("_o").cast("long").alias("n"), F.sum("_d").cast("long").alias("df"))
    return vocabulary(stats, min_df=min_df, max_features=max_features, stop_words=stop_words)


def term_counts_by_dim(
    df: DataFrame,
    text: str,
    id_col: str,
    key: str,
    dims: DataFrame,
    dim_names: Sequence[str],
    top: int | None = None,
    max_features: int = 1000,
    stop_words: Iterable[str] | None = None,
) -> DataFrame:
    """(dim, key, term, n): vocabulary term counts per key of each dimension, dense: every
    key has a row for every vocabulary term, 0 where the term does not occur.

    ``dims`` maps ``key`` to the other dimension columns (``dim_names``).  Counts are
    aggregated once per (key, term), then widened with grouping sets, so the Expand
    multiplies only the pre-aggregated rows.  ``top`` gives a report of the first terms per
    (dim, key) by count desc, term asc instead, with their ``rank``.
    """
    checkpoint_dir(df.sparkSession)
    stats = key_term_counts(df, text, key, id_col).checkpoint()  # read twice: vocabulary and counts
    vocab = vocabulary(stats, max_features=max_features, stop_words=stop_words).select("term")
    kt = stats.join(F.broadcast(vocab), "term").select(key, "term", "n")  # vocab <= max_features rows
    wide = kt.join(dims.select(key, *dim_names), key)
    sets = [[d, "term"] for d in [key, *dim_names]]
    grouped = wide.groupingSets(sets, *[key, *dim_names], "term").agg(
        F.sum("n").cast("long").alias("n"), F.grouping_id().alias("_g")
    )
    names = [key, *dim_names]
    dim_col = F.coalesce(*[F.when(F.col(c).isNotNull() & (F.col("_g") == _gid(names, c)), F.lit(c)) for c in names])
    key_col = F.coalesce(*[F.when(F.col("_g") == _gid(names, c), F.col(c).cast("string")) for c in names])
    out = grouped.select(dim_col.alias("dim"), key_col.alias("key"), "term", "n").filter(F.col("key").isNotNull())
    if top is None:
        # the vocabulary has at most max_features terms: one bounded array for every key
        terms = vocab.agg(F.collect_list("term")).scalar()
        links = dims.select(key, *dim_names).join(stats.select(key).distinct(), key, "left_semi")
        pairs = F.array(*[F.struct(F.lit(c).alias("dim"), F.col(c).cast("string").alias("key")) for c in names])
        every = links.select(F.inline(pairs)).where(F.col("key").isNotNull()).distinct()
        grid = every.withColumn("_terms", terms).select("dim", "key", F.explode("_terms").alias("term"))
        return grid.join(out, ["dim", "key", "term"], "left").select("dim", "key", "term", F.coalesce("n", F.lit(0)).alias("n"))
    return top_n_per_key(out, ["dim", "key"], [F.desc("n"), F.asc("term")], top, "rank")


def _gid(names: Sequence[str], keep: str) -> int:
    """grouping_id of a set holding only ``keep`` (and term, which is always grouped)."""
    gid = 0
    for c in names:
        gid = (gid << 1) | (0 if c == keep else 1)
    return gid << 1  # term is the last grouping column and always present


# --- T10 / J10 --------------------------------------------------------------
def remove_stopwords(df: DataFrame, text: str, stop_words: Iterable[str], out: str | None = None) -> DataFrame:
    return df.withColumn(out or text, tx.remove_stopwords(text, stop_words))


# --- J11 / T16 --------------------------------------------------------------
_TOKEN_RE = r"(?U)(\s*)(\w+|[^\w\s])"
_PARTS_RE = r"(?U)(\s*)(?:(\w+)|([^\w\s]))"
_WORD_RE = r"(?U)\w+"
_OPEN = pa.struct([("form", pa.string()), ("token", pa.string()), ("sep", pa.string())])
OFTEN = 65536  # most frequent forms whose dictionary entries every task holds


def tagged_tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, pos, sep, token, sentence): word and punctuation tokens of each text with the
    whitespace before them (space / newline / none) and a sentence index that
    increases after each '.', '!' or '?' token.

    The text is first split after every sentence-ending character, so the sentence
    index is the segment position: no window over a document is needed.  ``pos``
    orders tokens within a text (sentence in the high bits).
    """
    sents = df.select(id_col, F.posexplode(F.split(F.col(text), r"(?<=[.!?])", -1)).alias("sentence", "_seg"))
    seps = F.regexp_extract_all(F.col("_seg"), F.lit(_TOKEN_RE), 1)
    toks = F.regexp_extract_all(F.col("_seg"), F.lit(_TOKEN_RE), 2)
    z = sents.select(id_col, "sentence", F.posexplode(F.arrays_zip(seps.alias("s"), toks.alias("t"))).alias("_p", "z"))
    sep = F.when(F.col("z.s") == "", F.lit("none")).when(F.col("z.s").contains("\n"), F.lit("newline")).otherwise(F.lit("space"))
    pos = F.shiftleft(F.col("sentence").cast("long"), 32) + F.col("_p")
    return z.select(id_col, pos.alias("pos"), sep.alias("sep"), F.col("z.t").alias("token"), F.col("sentence").cast("long").alias("sentence"))


def lemmatize_by_dictionary(df: DataFrame, id_col: str, text: str, dictionary: DataFrame, tagset: str = "full", keep_interp: bool = False, out: str = "lemmatized") -> DataFrame:
    """Replace each token by its dictionary lemma and rebuild the text.

    ``dictionary`` is (form, lemma, pos) keyed on the lower-cased form; punctuation is
    tagged ``interp``; unknown words keep their form with tag ``ign``.  Tokens are
    filtered by ``tagset`` / ``keep_interp`` and joined back in order with their
    separators (a newline in the first sentence is dropped).

    The entries of the ``OFTEN`` most frequent forms go to every task, which rebuilds texts where
    it reads them.  Only forms beyond them are joined, and only the texts that hold one wait for
    it; no frequent form is a join key.  Texts whose id occurs more than once are one text.
    """
    checkpoint_dir(df.sparkSession)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    again = texts.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _id IS NOT NULL").select("_id").checkpoint()
    if again.isEmpty():
        done = _rebuilt(texts, dictionary, tagset, keep_interp)
    else:
        once = _rebuilt(texts.join(again, "_id", "left_anti"), dictionary, tagset, keep_interp)
        whole = _rebuilt_by_token(texts.join(again, "_id", "left_semi"), dictionary, tagset, keep_interp)
        done = once.unionByName(whole)
    return done.select(F.col("_id").alias(id_col), F.when(F.col("_id").isNull(), "").otherwise(F.coalesce("_out", F.lit(""))).alias(out))


def _rebuilt(texts: DataFrame, dictionary: DataFrame, tagset: str, keep_interp: bool) -> DataFrame:
    """(_id, _out) of texts whose ids occur once."""
    full = dictionary.select("form", "lemma", F.col("pos").alias("tag"))
    words = F.transform(F.regexp_extract_all("_text", F.lit(_WORD_RE), 0), lambda w: F.lower(w))
    often = texts.select(F.explode(words).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("_n"))
    often = often.orderBy(F.desc("_n"), "form").limit(OFTEN).checkpoint()
    entries = often.join(full, "form", "left").select("form", "lemma", F.coalesce("tag", F.lit("ign")).alias("tag"))
    entries = entries.withColumn("keep", tx.keep_tagged_token(F.col("tag"), tagset, keep_interp)).collect()
    times = Counter(r["form"] for r in entries)
    table = [r for r in entries if times[r["form"]] == 1] or [{"form": "", "lemma": None, "keep": False}]
    shared = texts.sparkSession.sparkContext.broadcast((
        pa.array([r["form"] for r in table], pa.string()), pa.array([r["lemma"] for r in table], pa.string()),
        np.array([r["keep"] for r in table], bool), keep_interp,
    ))
    get = lambda k: F.regexp_extract_all("_text", F.lit(_PARTS_RE), k)
    parts = texts.select("_id", get(1).alias("s"), get(2).alias("w"), get(3).alias("p")).withColumn("f", F.transform("w", lambda w: F.lower(w)))
    id_type = dict(parts.dtypes)["_id"]
    parts = parts.mapInArrow(_rebuild(shared), f"_id {id_type}, _out string, _between array<string>, _open array<struct<form: string, token: string, sep: string>>")
    if len(times) == len(entries) < OFTEN:  # every form of the texts is there, with one entry
        return parts.select("_id", "_out")
    parts = parts.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    tokens = parts.where("_out IS NULL").select("_row", F.posexplode("_open").alias("_i", "z")).select("_row", "_i", "z.form", "z.token", "z.sep")
    j = tokens.join(full, "form", "left")
    kept = j.where(tx.keep_tagged_token(F.coalesce("tag", F.lit("ign")), tagset, keep_interp))
    kept = kept.select("_row", F.struct("_i", F.concat("sep", F.coalesce("lemma", "token")).alias("p")).alias("z"))
    found = kept.groupBy("_row").agg(F.array_sort(F.collect_list("z")).alias("_z"))
    waiting = parts.where("_out IS NULL").select("_id", "_row", "_between").join(found, "_row", "left")
    # what stands before the i-th open token sorts before its pieces, the rest last
    before = F.transform("_between", lambda b, i: F.struct(i.alias("_i"), F.lit(0).alias("_k"), b.alias("p")))
    after = F.transform(F.coalesce("_z", F.array()), lambda z: F.struct(z["_i"].alias("_i"), F.lit(1).alias("_k"), z["p"].alias("p")))
    joined = F.array_join(F.transform(F.array_sort(F.concat(before, after)), lambda z: z["p"]), "")
    return parts.where("_out IS NOT NULL").select("_id", "_out").unionByName(waiting.select("_id", joined.alias("_out")))


def _rebuild(shared):
    """Per text: rebuilt, or the texts between tokens whose form is not in the table, and these."""

    def run(batches):
        forms, lemmas, keeps, keep_interp = shared.value
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy()
            sep, word, mark, form = (b.column(i).flatten() for i in range(1, 5))
            first = np.cumsum(size) - size  # of each text's tokens
            is_word = _flags(pc.not_equal(word, ""))
            ends = np.concatenate([[0], np.cumsum(_flags(pc.is_in(mark, value_set=pa.array([".", "!", "?"]))))])
            later = ends[:-1] > np.repeat(ends[first], size)  # beyond the first sentence
            line = _flags(pc.match_substring(sep, "\n"))
            code = np.where(_flags(pc.equal(sep, "")) | (line & ~later), 0, np.where(line, 1, 2))
            gap = pa.array(["", "\n", " "]).take(pa.array(code))
            at = pc.index_in(form, value_set=forms)
            known = _flags(pc.is_valid(at))
            is_open = is_word & ~known
            keep = np.where(is_word, known & keeps[pc.fill_null(at, 0).to_numpy()], keep_interp)
            core = pc.if_else(pa.array(is_word), pc.coalesce(lemmas.take(at), word), mark)
            piece = pc.if_else(pa.array(keep), pc.binary_join_element_wise(gap, core, ""), "")
            # runs of pieces: a text's first one, and one after each open token
            opens = np.diff(np.concatenate([[0], np.cumsum(is_open)])[np.append(first, size.sum())])
            starts = np.sort(np.concatenate([first, np.flatnonzero(is_open) + 1, [size.sum()]]), kind="stable")
            runs = pc.binary_join(pa.ListArray.from_arrays(starts.astype(np.int32), piece), "")
            waits = opens > 0
            lead = np.cumsum(opens + 1) - (opens + 1)
            out = pc.if_else(pa.array(waits), pa.scalar(None, pa.string()), runs.take(pa.array(lead)))
            between = runs.filter(pa.array(np.repeat(waits, opens + 1)))
            held = pa.array(is_open)
            open_ = pa.StructArray.from_arrays([x.filter(held) for x in (form, word, gap)], fields=list(_OPEN))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), out, pa.ListArray.from_arrays(_offsets(np.where(waits, opens + 1, 0)), between), pa.ListArray.from_arrays(_offsets(opens), open_)],
                names=["_id", "_out", "_between", "_open"],
            )

    return run


def _flags(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(bool)


def _offsets(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int32)


def _rebuilt_by_token(texts: DataFrame, dictionary: DataFrame, tagset: str, keep_interp: bool) -> DataFrame:
    """(_id, _out) by a row per token, for ids that occur more than once: the tokens of their texts
    are merged by place."""
    toks = tagged_tokens(texts, "_id", "_text")
    is_word = F.col("token").rlike(r"(?U)^\w+$")
    toks = toks.withColumn("form", F.lower("token"))
    dic = dictionary.select(F.col("form"), F.col("lemma"), F.col("pos").alias("tag"))
    j = toks.join(dic, "form", "left")
    tag = F.when(~is_word, F.lit("interp")).otherwise(F.coalesce(F.col("tag"), F.lit("ign")))
    lemma = F.when(~is_word, F.col("token")).otherwise(F.coalesce(F.col("lemma"), F.col("token")))
    j = j.select("_id", "pos", "sep", "sentence", tag.alias("tag"), lemma.alias("lemma"))
    kept = j.filter(tx.keep_tagged_token(F.col("tag"), tagset, keep_interp))
    piece = F.concat(tx.separator_text(F.col("sep"), F.col("sentence")), F.col("lemma"))
    rebuilt = kept.groupBy("_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("p")))), lambda s: s["p"]), "").alias("_out")
    )
    return texts.select("_id").join(rebuilt, "_id", "left")


def lemma_dictionary_from_corpus(df: DataFrame, text: str) -> DataFrame:
    """A deterministic stand-in dictionary: every distinct lower-cased word form, lemma =
    its first five characters, tag chosen by length."""
    forms = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?U)\w+"), 0)).alias("form")).distinct()
    tags = F.element_at(F.array(F.lit("subst"), F.lit("fin"), F.lit("adj"), F.lit("ger")), (F.length("form") % 4 + 1).cast("int"))
    return forms.select("form", F.substring("form", 1, 5).alias("lemma"), tags.alias("pos"))
