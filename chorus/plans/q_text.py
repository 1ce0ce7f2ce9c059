"""Text queries: cleaning, emoji, tokens, stop words, rows for training files,
lemma rebuild, tagged tokens, two-column explode."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.functions import text as tx
from chorus.operators import aggregate as agg
from chorus.operators import corpus, subwords
from chorus.plans import fixtures as fx
from chorus.plans.fixtures import SQL_W, sql_clean, sql_tokens, with_ctes
from chorus.plans.registry import query
from chorus.sources.tables import table

_STOP_SQL = "[" + ", ".join(f"'{w}'" for w in fx.STOP_WORDS) + "]"


@query("clean_text", with_ctes("posts") + f"SELECT id, {sql_clean('tweet')} AS tweet FROM posts")
def clean_text(spark, sf):
    return fx.posts(spark, sf).select("id", tx.clean_text("tweet").alias("tweet"))


@query("clean_text_no_pl", with_ctes("posts") + f"SELECT id, {sql_clean('tweet', strip_pl=False)} AS tweet FROM posts")
def clean_text_no_pl(spark, sf):
    return fx.posts(spark, sf).select("id", tx.clean_text("tweet", strip_pl=False).alias("tweet"))


def _sql_emoji(expr: str) -> str:
    for k, v in fx.EMOJI_MAP:
        expr = f"replace({expr}, '{k}', '<{v}>')"
    return expr


@query("emoji_to_text", with_ctes("posts") + f"SELECT id, {_sql_emoji('tweet')} AS tweet FROM posts")
def emoji_to_text(spark, sf):
    return fx.posts(spark, sf).select("id", tx.emoji_to_text("tweet", fx.EMOJI_MAP).alias("tweet"))


_SQL_ANNOT = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(tweet, '(https?://|www\\.)\\S+', '', 'g'), "
    f"'@{SQL_W}+', '', 'g'), '(^|[^@#\\p{{L}}\\p{{M}}\\p{{N}}_])(RT|FAV)([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)', '\\1\\3', 'g'), "
    "'\\s+', ' ', 'g'))"
)


@query(
    "clean_for_annotation",
    with_ctes("posts") + f"SELECT id, t AS text FROM (SELECT id, {_SQL_ANNOT} AS t FROM posts) WHERE t IS NOT NULL AND t <> ''",
)
def clean_for_annotation(spark, sf):
    c = fx.posts(spark, sf).select("id", tx.clean_for_annotation("tweet").alias("text"))
    return c.filter(F.col("text").isNotNull() & (F.col("text") != ""))


@query("normalise_label_text", with_ctes("posts") + "SELECT id, lower(replace(tweet, '#', '')) AS text FROM posts")
def normalise_label_text(spark, sf):
    return fx.posts(spark, sf).select("id", tx.normalise_text("tweet").alias("text"))


@query(
    "tokenise",
    "SELECT doc_id, array_to_string(" + sql_tokens("text") + ", ' ') AS tokens, "
    "CAST(len(" + sql_tokens("text") + ") AS BIGINT) AS n_tokens FROM documents",
)
def tokenise(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tx.tokenise("text").alias("t"))
    return d.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


@query(
    "token_count_hist",
    "WITH c AS (SELECT CAST(len(" + sql_tokens("text") + ") AS DOUBLE) AS x FROM documents), "
    "m AS (SELECT min(x) AS lo, max(x) AS hi FROM c) "
    "SELECT CAST(CASE WHEN m.hi = m.lo THEN 0 ELSE least(floor((x - m.lo) / ((m.hi - m.lo) / 100.0)), 99) END AS BIGINT) AS bin, "
    "count(*) AS n FROM c, m GROUP BY 1",
)
def token_count_hist(spark, sf):
    d = table(spark, sf, "documents").select(tx.token_count("text").alias("x"))
    return agg.hist_fixed_bins(d, "x", 100)


@query(
    "remove_stopwords",
    with_ctes("posts")
    + f"SELECT id, array_to_string(list_filter(string_split(lower({sql_clean('tweet')}), ' '), lambda t: NOT list_contains({_STOP_SQL}, t)), ' ') AS text FROM posts",
)
def remove_stopwords(spark, sf):
    p = fx.posts(spark, sf).select("id", F.lower(tx.clean_text("tweet")).alias("text"))
    return corpus.remove_stopwords(p, "text", fx.STOP_WORDS)


@query(
    "format_training_row",
    "SELECT conv_id, turn, '__label__' || role || ' ' || lower(text) AS row FROM conversations",
)
def format_training_row(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", tx.format_training_row("role", F.lower("text")).alias("row"))


def _quoted_lines_sql() -> str:
    return (
        "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '\"' || t || '\"' WHEN 1 THEN '\"' || t "
        "WHEN 2 THEN '\"' ELSE t END AS line FROM (SELECT conv_id, turn, regexp_replace(text, '[\\r\\n]', ' ', 'g') AS t FROM conversations)"
    )


@query(
    "strip_line_quotes",
    "SELECT conv_id, turn, CASE WHEN line = '\"' THEN '' ELSE regexp_replace(line, '^\"(.*)\"$', '\\1') END AS line FROM ("
    + _quoted_lines_sql()
    + ")",
)
def strip_line_quotes(spark, sf):
    c = table(spark, sf, "conversations")
    t = F.regexp_replace("text", r"[\r\n]", " ")
    q = F.lit('"')
    k = F.col("turn") % 4
    line = F.when(k == 0, F.concat(q, t, q)).when(k == 1, F.concat(q, t)).when(k == 2, q).otherwise(t)
    return c.select("conv_id", "turn", tx.strip_line_quotes(line).alias("line"))


_SQL_EX = """SELECT conv_id, turn, 0 AS which, text AS example FROM conversations WHERE role <> 'system'
UNION ALL
SELECT conv_id, turn, 1 AS which, sec AS example FROM (
  SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN NULL WHEN turn % 3 = 1 THEN '' ELSE '> ' || text END AS sec
  FROM conversations) WHERE role <> 'system' AND sec IS NOT NULL AND sec <> ''"""


@query("explode_examples", _SQL_EX)
def explode_examples(spark, sf):
    """Lexical units -> example rows: the primary example always, the secondary only
    when it is neither null nor empty; units that are not emotional give nothing."""
    c = table(spark, sf, "conversations")
    units = c.select(
        "conv_id",
        "turn",
        (F.col("role") != "system").alias("is_emotional"),
        F.col("text").alias("emotion_example"),
        F.when(F.col("turn") % 3 == 0, F.lit(None).cast("string"))
        .when(F.col("turn") % 3 == 1, F.lit(""))
        .otherwise(F.concat(F.lit("> "), F.col("text")))
        .alias("emotion_example_secondary"),
    )
    cand = F.array(
        F.struct(F.lit(0).alias("which"), F.col("emotion_example").alias("example")),
        F.struct(F.lit(1).alias("which"), F.col("emotion_example_secondary").alias("example")),
    )
    kept = F.filter(cand, lambda s: (s["which"] == 0) | (s["example"].isNotNull() & (s["example"] != "")))
    return units.filter("is_emotional").select("conv_id", "turn", F.inline(kept))


# --- lemma rebuild ------------------------------------------------------------
_SQL_TAGGED = r"""tok AS (
  SELECT doc_id, i - 1 AS pos, sa[i] AS s, ta[i] AS t FROM (
    SELECT doc_id, regexp_extract_all(text, '(\s*)([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s])', 1) AS sa,
                   regexp_extract_all(text, '(\s*)([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s])', 2) AS ta
    FROM documents) d, range(1, len(ta) + 1) r(i)),
tagged AS (
  SELECT doc_id, pos, t,
    CASE WHEN s = '' THEN 'none' WHEN contains(s, chr(10)) THEN 'newline' ELSE 'space' END AS sep,
    COALESCE(sum(CASE WHEN t IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence
  FROM tok),
dict AS (
  SELECT form, substr(form, 1, 5) AS lemma,
    CASE length(form) % 4 WHEN 0 THEN 'subst' WHEN 1 THEN 'fin' WHEN 2 THEN 'adj' ELSE 'ger' END AS tag
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS form FROM documents)),
lem AS (
  SELECT g.doc_id, g.pos, g.sep, g.sentence,
    CASE WHEN regexp_full_match(g.t, '[\p{L}\p{M}\p{N}_]+') THEN COALESCE(d.tag, 'ign') ELSE 'interp' END AS tag,
    CASE WHEN regexp_full_match(g.t, '[\p{L}\p{M}\p{N}_]+') THEN COALESCE(d.lemma, g.t) ELSE g.t END AS lemma
  FROM tagged g LEFT JOIN dict d ON lower(g.t) = d.form)"""


def _sql_rebuild(keep: str) -> str:
    return (
        "WITH "
        + _SQL_TAGGED
        + ", kept AS (SELECT * FROM lem WHERE "
        + keep
        + ") SELECT d.doc_id, COALESCE(r.lemmatized, '') AS lemmatized FROM documents d LEFT JOIN ("
        "SELECT doc_id, string_agg(CASE WHEN sep = 'space' THEN ' ' WHEN sep = 'newline' AND sentence <> 0 THEN chr(10) ELSE '' END || lemma, '' ORDER BY pos) AS lemmatized "
        "FROM kept GROUP BY doc_id) r ON d.doc_id = r.doc_id"
    )


@query("rebuild_tagged_text", _sql_rebuild("tag <> 'interp' OR true"))
def rebuild_tagged_text(spark, sf):
    d = table(spark, sf, "documents")
    dic = corpus.lemma_dictionary_from_corpus(d, "text")
    return corpus.lemmatize_by_dictionary(d, "doc_id", "text", dic, tagset="full", keep_interp=True)


@query("lemmatize_by_dictionary", _sql_rebuild("tag IN ('subst', 'depr', 'ger')"))
def lemmatize_by_dictionary(spark, sf):
    d = table(spark, sf, "documents")
    dic = corpus.lemma_dictionary_from_corpus(d, "text")
    return corpus.lemmatize_by_dictionary(d, "doc_id", "text", dic, tagset="noun", keep_interp=False)


def _subwords(spark, sf):
    """Subword counts of all documents, by the tokenizer file that the environment names."""
    import os

    path = os.environ.get("CHORUS_TOKENIZER")
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return subwords.subword_counts(table(spark, sf, "documents").select("doc_id", "text"), "text", path)


@query("subword_counts")
def subword_counts(spark, sf):
    """Subwords of every document, start and end token included."""
    return _subwords(spark, sf).select("doc_id", "n_subwords")


@query("subword_count_hist")
def subword_count_hist(spark, sf):
    """Histogram of the subword counts in 200 bins."""
    return agg.hist_fixed_bins(_subwords(spark, sf).select(F.col("n_subwords").alias("x")), "x", 200)


# Every character from the Arrows block on is a key here, some with a following selector
MANY = [(chr(c), f"u{c:x}") for c in range(0x2190, 0x2BFF)] + [(chr(c), f"u{c:x}") for c in range(0x1F300, 0x1FAFF)]


@query(
    "emoji_large_map",
    with_ctes("posts")
    + "SELECT id, array_to_string(list_transform(string_split(tweet, ''), lambda c: CASE WHEN (ord(c) BETWEEN 8592 AND 11262) OR (ord(c) BETWEEN 127744 AND 129790) "
    "THEN '<u' || lower(hex(ord(c))) || '>' ELSE c END), '') AS tweet FROM posts",
)
def emoji_large_map(spark, sf):
    """A map of thousands of keys in one pass."""
    return fx.posts(spark, sf).select("id", tx.emoji_to_text("tweet", MANY).alias("tweet"))
