"""Reference-shaped inputs derived from the driver tables.

Each role of the reference's data model (posts, accounts, annotations, truth /
prediction pairs, topic distributions, run histories, candidate lists, grids) is
derived deterministically from a driver table, so every query's work grows with
the tables.  ``SQL_CTES`` holds the same derivations in DuckDB SQL for the oracles;
the two sides must stay in lock-step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chorus.operators.ranking import position_within
from chorus.sources.tables import table

# ---------------------------------------------------------------------------
# Fixed values of the fixtures (kept identical in the oracle SQL below)
# Emoji map, in order: 😀 -> grinning face, 🙂 -> slightly smiling face,
#                      <grinning face> is not a key, so order only matters for
#                      overlapping keys; 😀🙂 -> pair of faces comes last and never
#                      fires because the single keys are replaced first.
# Share labels (A4): click, purchase, signup, view   ('error' stays in the denominator)
# Stop words of the fixtures: the, and, of, to, in, a, le, la, de, et, les, der,
#                             die, und, das, el, y, en, los
# ---------------------------------------------------------------------------
EMOJI_MAP = [("😀", "grinning face"), ("🙂", "slightly smiling face"), ("😀🙂", "pair of faces")]
SHARE_LABELS = ["click", "purchase", "signup", "view"]
STOP_WORDS = ["the", "and", "of", "to", "in", "a", "le", "la", "de", "et", "les", "der", "die", "und", "das", "el", "y", "en", "los"]


def _s(c):
    return F.col(c).cast("string")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """posts(id, username, language, tweet) from documents; links, mentions, hashes and
    emoji are spliced in by ``doc_id % 6`` so every cleaning rule fires."""
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id") % 6
    i = _s("doc_id")
    t = F.col("text")
    tweet = (
        F.when(k == 0, F.concat(F.lit("RT @user"), i, F.lit(" "), t, F.lit(" https://t.co/x"), i))
        .when(k == 1, F.concat(t, F.lit(" #news"), i, F.lit(" portal.com/a"), i))
        .when(k == 2, F.concat(F.lit("@łukasz_"), i, F.lit(" "), t, F.lit(" wp.pl/x"), i, F.lit(" 😀")))
        .when(k == 3, F.concat(t, F.lit("  🙂 x.com")))
        .when(k == 4, F.concat(F.lit("#"), t, F.lit(" 😀🙂")))
        .otherwise(t)
    )
    return d.select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 97 == 96, F.lit(None).cast("string")).otherwise(F.col("source")).alias("username"),
        F.when(F.col("doc_id") % 89 == 88, F.lit(None).cast("string")).otherwise(F.col("lang")).alias("language"),
        tweet.alias("tweet"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accounts(username, party, coalition, role): upper-case names; the accounts from 18 up
    write no posts."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.when(F.col("n_nationkey") < 18, F.lit("SRC")).otherwise(F.lit("QUIET")), _s("n_nationkey")).alias("username"),
        F.col("n_name").alias("party"),
        F.col("r_name").alias("coalition"),
        F.concat(F.lit("role"), (F.col("n_nationkey") % 3).cast("string")).alias("role"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide annotation table: item + four rater columns (strings, some blank)."""
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    j = lab.join(doc, "doc_id")
    return j.select(
        F.col("doc_id").alias("item"),
        F.when(F.col("doc_id") % 13 == 0, F.lit(None).cast("string")).otherwise(_s("quality")).alias("r1"),
        _s("toxic").alias("r2"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("n_chars") > 1000, F.lit("1"))
        .otherwise(F.lit("0"))
        .alias("r3"),
        F.when(F.col("lang") == "en", F.lit("1")).otherwise(F.lit("0")).alias("r4"),
    )


def predictions(spark: SparkSession, sf_dir: str, variant: bool = False) -> DataFrame:
    """(item, truth, pred) from embeddings; the variant has a class never true (c9) and one
    never predicted (c0)."""
    e = table(spark, sf_dir, "embeddings")
    truth = F.col("label")
    pred = F.when(F.col("vec_id") % 3 == 0, F.col("vec_id") % 10).otherwise(F.col("label"))
    if variant:
        truth = F.least(F.col("label"), F.lit(8))
        pred = F.when(pred == 0, F.lit(10)).otherwise(pred)
    return e.select(
        F.col("vec_id").alias("item"),
        F.concat(F.lit("c"), truth.cast("string")).alias("truth"),
        F.concat(F.lit("c"), pred.cast("string")).alias("pred"),
    )


def topic_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, dist array<double>): |embedding entries| normalised to 1."""
    e = table(spark, sf_dir, "embeddings")
    a = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    tot = F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return e.select("vec_id", "label", F.transform(a, lambda x: x / tot).alias("dist"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, vec array<double>)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def run_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, score): run = user_id, epoch = 1.. by (ts, event_id), score = value."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    pos = position_within(ev, ["user_id"], ["ts", "event_id"], out="_pos")
    return pos.select(
        F.col("user_id").alias("run"),
        (F.col("_pos") + 1).alias("epoch"),
        F.col("value").alias("score"),
    )


def share_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, party, coalition, label) from events for the label-share reports."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        _s("user_id").alias("user"),
        F.concat(F.lit("P"), (F.col("user_id") % 7).cast("string")).alias("party"),
        F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("coalition"),
        F.col("event_type").alias("label"),
    )


# ---------------------------------------------------------------------------
# The same derivations in DuckDB SQL.
# ---------------------------------------------------------------------------
SQL_CTES = {
    "posts": """posts AS (SELECT doc_id AS id,
  CASE WHEN doc_id % 97 = 96 THEN NULL ELSE source END AS username,
  CASE WHEN doc_id % 89 = 88 THEN NULL ELSE lang END AS language,
  CASE doc_id % 6
    WHEN 0 THEN 'RT @user' || CAST(doc_id AS VARCHAR) || ' ' || text || ' https://t.co/x' || CAST(doc_id AS VARCHAR)
    WHEN 1 THEN text || ' #news' || CAST(doc_id AS VARCHAR) || ' portal.com/a' || CAST(doc_id AS VARCHAR)
    WHEN 2 THEN '@łukasz_' || CAST(doc_id AS VARCHAR) || ' ' || text || ' wp.pl/x' || CAST(doc_id AS VARCHAR) || ' 😀'
    WHEN 3 THEN text || '  🙂 x.com'
    WHEN 4 THEN '#' || text || ' 😀🙂'
    ELSE text END AS tweet
  FROM documents)""",
    "accounts": """accounts AS (SELECT CASE WHEN n.n_nationkey < 18 THEN 'SRC' ELSE 'QUIET' END || CAST(n.n_nationkey AS VARCHAR) AS username, n.n_name AS party,
  r.r_name AS coalition, 'role' || CAST(n.n_nationkey % 3 AS VARCHAR) AS role
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)""",
    "annotations": """annotations AS (SELECT l.doc_id AS item,
  CASE WHEN l.doc_id % 13 = 0 THEN NULL ELSE CAST(l.quality AS VARCHAR) END AS r1,
  CAST(l.toxic AS VARCHAR) AS r2,
  CASE WHEN l.doc_id % 11 = 0 THEN NULL WHEN d.n_chars > 1000 THEN '1' ELSE '0' END AS r3,
  CASE WHEN d.lang = 'en' THEN '1' ELSE '0' END AS r4
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)""",
    "predictions": """predictions AS (SELECT vec_id AS item, 'c' || CAST(label AS VARCHAR) AS truth,
  'c' || CAST(CASE WHEN vec_id % 3 = 0 THEN vec_id % 10 ELSE label END AS VARCHAR) AS pred FROM embeddings)""",
    "predictions2": """predictions2 AS (SELECT vec_id AS item, 'c' || CAST(LEAST(label, 8) AS VARCHAR) AS truth,
  'c' || CAST(CASE WHEN (CASE WHEN vec_id % 3 = 0 THEN vec_id % 10 ELSE label END) = 0 THEN 10
                   ELSE (CASE WHEN vec_id % 3 = 0 THEN vec_id % 10 ELSE label END) END AS VARCHAR) AS pred
  FROM embeddings)""",
    "topic_long": """topic_raw AS (SELECT vec_id, label, i - 1 AS topic, abs(CAST(embedding[i] AS DOUBLE)) AS a
  FROM embeddings, range(1, len(embedding) + 1) t(i)),
topic_long AS (SELECT vec_id, label, topic, a / sum(a) OVER (PARTITION BY vec_id) AS p FROM topic_raw)""",
    "vec_long": """vec_long AS (SELECT vec_id, label, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x
  FROM embeddings, range(1, len(embedding) + 1) t(i))""",
    "run_histories": """run_histories AS (SELECT user_id AS run,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS epoch, value AS score FROM events)""",
    "share_events": """share_events AS (SELECT CAST(user_id AS VARCHAR) AS "user", 'P' || CAST(user_id % 7 AS VARCHAR) AS party,
  'C' || CAST(user_id % 3 AS VARCHAR) AS coalition, event_type AS label FROM events)""",
}


def with_ctes(*names: str) -> str:
    return "WITH " + ",\n".join(SQL_CTES[n] for n in names) + "\n"


# DuckDB spellings of the Java (?U) classes
SQL_W = r"[\p{L}\p{M}\p{N}_]"


def sql_clean(expr: str, strip_pl: bool = True) -> str:
    s = f"regexp_replace({expr}, 'http\\S+', '', 'g')"
    s = f"regexp_replace({s}, '\\S+\\.com\\S+', '', 'g')"
    if strip_pl:
        s = f"regexp_replace({s}, '\\S+\\.pl\\S+', '', 'g')"
    s = f"regexp_replace({s}, '@{SQL_W}+', '', 'g')"
    s = f"replace({s}, '#', '')"
    return f"regexp_replace({s}, '\\s+', ' ', 'g')"


def sql_tokens(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), '{SQL_W}{{2,}}')"
