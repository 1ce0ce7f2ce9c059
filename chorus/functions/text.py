"""Text column expressions.

All functions here return Spark Columns built from JVM-side expressions (regex,
higher-order array functions), so they stay inside whole-stage codegen and run
unchanged on batch and streaming DataFrames.  Java regex needs ``(?U)`` to give
``\\w``/``\\s``/``\\b`` their Unicode meaning, which the reference's regex engine has
by default.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chorus.functions.replace import replacer

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Reserved words removed by the annotation cleaner: RT, FAV
# Part-of-speech tag sets of the lemma rebuild:
#   noun: subst, depr, ger
#   verb: fin, praet, impt, imps, inf
#   adj:  adj, adja, adjp, adjc, pact, ppas
# Label-line marker: __label__
# ---------------------------------------------------------------------------
RESERVED_WORDS = ("RT", "FAV")
NOUN_TAGS = ("subst", "depr", "ger")
VERB_TAGS = ("fin", "praet", "impt", "imps", "inf")
ADJ_TAGS = ("adj", "adja", "adjp", "adjc", "pact", "ppas")
LABEL_MARK = "__label__"

# The unanchored reference patterns ``\S+\.com\S+`` backtrack quadratically in Java on
# long runs without spaces; anchoring the start at a run boundary keeps the same
# matches (the leftmost match always starts at the run start) in linear time.
_LINK_HTTP = r"(?U)http\S+"
_LINK_COM = r"(?U)(?<!\S)\S+\.com\S+"
_LINK_PL = r"(?U)(?<!\S)\S+\.pl\S+"
_MENTION = r"(?U)@\w+"
_SPACES = r"(?U)\s+"
TOKEN_PATTERN = r"(?U)\b\w\w+\b"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def remove_links(col: Column | str, strip_pl: bool = True) -> Column:
    c = F.regexp_replace(_c(col), _LINK_HTTP, "")
    c = F.regexp_replace(c, _LINK_COM, "")
    if strip_pl:
        c = F.regexp_replace(c, _LINK_PL, "")
    return c


def remove_mentions(col: Column | str) -> Column:
    return F.regexp_replace(_c(col), _MENTION, "")


def remove_hash_signs(col: Column | str) -> Column:
    return F.replace(_c(col), F.lit("#"), F.lit(""))


def collapse_spaces(col: Column | str) -> Column:
    """Every whitespace run becomes one space; deliberately no trim."""
    return F.regexp_replace(_c(col), _SPACES, " ")


def clean_text(col: Column | str, strip_pl: bool = True) -> Column:
    """Links, mentions and hash signs out, whitespace collapsed (not trimmed).

    ``strip_pl=False`` is the notebook variant without the ``.pl`` rule.
    """
    return collapse_spaces(remove_hash_signs(remove_mentions(remove_links(col, strip_pl))))


def with_clean(df: DataFrame, col: str, out: str, strip_pl: bool = True) -> DataFrame:
    """``df`` with ``out`` = cleaned ``col``, evaluated once per row: filters and projections
    that use ``out`` are not pushed through the generator that produces it."""
    rest = [c for c in df.columns if c != out]
    return df.select(*rest, F.inline(F.array(F.struct(clean_text(col, strip_pl).alias(out)))))


MANY_KEYS = 64  # from here on one pass, whatever the size of the map


def _in_one_pass(col: Column, mapping: list[tuple[str, str]]) -> Column:
    """As the loop, on the rows that hold a character from which a key may start."""
    def run(texts: pd.Series) -> pd.Series:
        one = replacer(mapping)
        return texts.map(one, na_action="ignore")

    lowest = min((ord(k[0]) for k, _ in mapping if k), default=0)
    pattern = f"[\\x{{{lowest:X}}}-\\x{{10FFFF}}]"
    return F.when(col.isNull() | ~col.rlike(pattern), col).otherwise(F.pandas_udf(run, "string")(col))


def emoji_to_text(col: Column | str, mapping: Sequence[tuple[str, str]] | Column) -> Column:
    """Replace each key by ``<description>`` sequentially in mapping order.

    Later entries see the output of earlier ones, exactly like a loop of
    ``str.replace``.  ``mapping`` is either a list of pairs (a literal array) or a
    Column of ``array<struct<k:string,v:string>>`` (e.g. a broadcast map per row).
    """
    def run(entries: Column) -> Column:
        return F.aggregate(entries, _c(col), lambda acc, e: F.replace(acc, e["k"], F.concat(F.lit("<"), e["v"], F.lit(">"))))

    def lit_entries(pairs) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in pairs]).cast("array<struct<k:string,v:string>>")

    if isinstance(mapping, Column):
        return run(mapping)
    if len(mapping) > MANY_KEYS:
        return _in_one_pass(_c(col), list(mapping))
    # A key none of whose characters occur in any inserted "<v>" can only
    # match text that was in the input already.  Rows that contain no first character
    # of such keys (most rows: no emoji) run only the other keys - exact, and the cost
    # of the full map is paid only by rows that contain a candidate character.
    inserted = set("<>").union(*[set(v) for _, v in mapping])
    safe_first = sorted({k[:1] for k, _ in mapping if k and not set(k) & inserted})
    rest = [(k, v) for k, v in mapping if not k or set(k) & inserted]
    if not safe_first:
        return run(lit_entries(mapping))
    guard = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in safe_first) + "]"
    return F.when(_c(col).rlike(guard), run(lit_entries(mapping))).otherwise(run(lit_entries(rest)) if rest else _c(col))


def clean_for_annotation(col: Column | str) -> Column:
    """Tool-style cleaner: URLs, mentions and reserved words out, spaces collapsed, trimmed."""
    c = F.regexp_replace(_c(col), r"(?U)(https?://|www\.)\S+", "")
    c = F.regexp_replace(c, _MENTION, "")
    c = F.regexp_replace(c, r"(?U)(?<![@#\w])(" + "|".join(RESERVED_WORDS) + r")(?!\w)", "")
    return F.trim(F.regexp_replace(c, _SPACES, " "))


def normalise_text(col: Column | str, lower: bool = True, drop_hash: bool = True) -> Column:
    c = _c(col)
    if drop_hash:
        c = remove_hash_signs(c)
    return F.lower(c) if lower else c


def text_length(col: Column | str) -> Column:
    """Length in code points (an emoji counts once), as a long."""
    return F.length(_c(col)).cast("long")


def tokenise(col: Column | str) -> Column:
    """Lower-cased runs of two or more word characters (the vectoriser default)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_PATTERN), 0)


def token_count(col: Column | str) -> Column:
    return F.size(tokenise(col)).cast("long")


def remove_stopwords(col: Column | str, stop_words: Iterable[str] | Column) -> Column:
    """Split on single spaces (empty tokens kept), drop stop words case-sensitively, keep
    duplicates and order, re-join with one space."""
    if isinstance(stop_words, Column):
        keep = lambda t: ~F.array_contains(stop_words, t)
    else:
        words = sorted(set(stop_words))
        keep = lambda t: ~t.isin(*words)  # noqa: E731  a literal list is a hash lookup
    return F.array_join(F.filter(F.split(_c(col), " ", -1), keep), " ")


def format_training_row(label: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit(LABEL_MARK), _c(label), F.lit(" "), _c(text))


def strip_line_quotes(col: Column | str) -> Column:
    """Remove one wrapping pair of double quotes when the line starts and ends with one
    (a lone quote is both, so it becomes empty); inner doubled quotes stay."""
    return F.regexp_replace(_c(col), r'(?s)^"(.*)"$|^"$', "$1")


def pos_tags(tagset: str) -> tuple[str, ...]:
    sets = {"full": (), "noun": NOUN_TAGS, "verb": VERB_TAGS, "adj": ADJ_TAGS}
    if tagset not in sets:
        raise ValueError(f"unknown tagset {tagset!r}")
    return sets[tagset]


def keep_tagged_token(pos: Column, tagset: str, keep_interp: bool) -> Column:
    """Keep rule of the lemma rebuild: punctuation only by flag, words by tag set."""
    tags = pos_tags(tagset)
    is_interp = pos == F.lit("interp")
    word_ok = F.lit(True) if not tags else pos.isin(*tags)
    return F.when(is_interp, F.lit(keep_interp)).otherwise(word_ok)


def separator_text(sep: Column, sentence: Column) -> Column:
    """space -> ' ', newline -> '\\n' except in the first sentence, none -> ''."""
    return (
        F.when(sep == "space", F.lit(" "))
        .when((sep == "newline") & (sentence != 0), F.lit("\n"))
        .otherwise(F.lit(""))
    )


def file_stem(path: Column | str | None = None) -> Column:
    """Stem of a file path (name without directory and last extension); by default of
    the file each row was read from."""
    p = F.input_file_name() if path is None else _c(path)
    return F.regexp_extract(p, r"([^/]*?)(\.[^./]*)?$", 1)
