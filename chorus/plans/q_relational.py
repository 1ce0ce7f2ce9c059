"""Projection, filter, join and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.functions import text as tx
from chorus.operators import relational as rel
from chorus.operators.ranking import position_within
from chorus.plans import fixtures as fx
from chorus.plans.fixtures import sql_clean, with_ctes
from chorus.plans.registry import query
from chorus.sources.tables import table


@query(
    "project_rename",
    with_ctes("posts", "accounts")
    + "SELECT p.id, a.party, a.coalition, a.role AS position, 10 AS weight FROM posts p JOIN accounts a ON lower(p.username) = lower(a.username)",
)
def project_rename(spark, sf):
    """Keep four columns of the scored posts, rename the role column, add a constant weight."""
    j = rel.join_lower_key(fx.posts(spark, sf).select("id", "username"), fx.accounts(spark, sf), "username", "username")
    return rel.project_rename(j, ["id", "party", "coalition", "role"], {"role": "position"}, {"weight": 10})


# Fixed values of the fixture recode (fine event types -> coarse classes)
RECODE = {"click": "engaged", "purchase": "engaged", "view": "passive"}


@query(
    "label_recode",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'engaged' WHEN 'purchase' THEN 'engaged' "
    "WHEN 'view' THEN 'passive' ELSE event_type END AS label FROM events",
)
def label_recode(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("event_type").alias("label"))
    return rel.recode(ev, "label", RECODE)


@query("filter_language", with_ctes("posts") + "SELECT id, username FROM posts WHERE language = 'en'")
def filter_language(spark, sf):
    return rel.filter_equal(fx.posts(spark, sf), "language", "en").select("id", "username")


@query(
    "filter_range",
    with_ctes("posts") + f"SELECT id, CAST(length({sql_clean('tweet')}) AS BIGINT) AS len FROM posts "
    f"WHERE length({sql_clean('tweet')}) BETWEEN 10 AND 2000",
)
def filter_range(spark, sf):
    p = tx.with_clean(fx.posts(spark, sf).select("id", "tweet"), "tweet", "t").select("id", tx.text_length("t").alias("len"))
    return rel.filter_range(p, "len", 10, 2000)


@query(
    "short_texts",
    f"SELECT DISTINCT t AS text FROM (SELECT {sql_clean('text')} AS t FROM documents) WHERE length(t) < 40",
)
def short_texts(spark, sf):
    d = tx.with_clean(table(spark, sf, "documents").select("text"), "text", "text")
    return rel.short_texts(d, "text", 40)


_SQL_MIN_ACT = (
    with_ctes("posts")
    + f", c AS (SELECT id, username FROM posts WHERE length({sql_clean('tweet')}) >= 10) "
    "SELECT id, username FROM c WHERE username IS NULL OR username NOT IN "
    "(SELECT username FROM c WHERE username IS NOT NULL GROUP BY username HAVING count(id) < 48)"
)


@query("min_activity", _SQL_MIN_ACT)
def min_activity(spark, sf):
    p = fx.posts(spark, sf)
    p = tx.with_clean(p.select("id", "username", "tweet"), "tweet", "t").filter(tx.text_length("t") >= 10).select("id", "username")
    return rel.min_activity(p, "username", "id", 48)


@query(
    "null_counts",
    with_ctes("posts")
    + "SELECT * FROM (VALUES ('id', (SELECT count(*) - count(id) FROM posts)), ('username', (SELECT count(*) - count(username) FROM posts)), "
    "('language', (SELECT count(*) - count(language) FROM posts)), ('tweet', (SELECT count(*) - count(tweet) FROM posts))) t(\"column\", nulls)",
)
def null_counts(spark, sf):
    return rel.null_counts(fx.posts(spark, sf), ["id", "username", "language", "tweet"])


# --- joins ----------------------------------------------------------------------
@query(
    "join_posts_accounts",
    with_ctes("posts", "accounts")
    + "SELECT p.id, p.username, a.party, a.coalition, a.role FROM posts p JOIN accounts a ON lower(p.username) = lower(a.username)",
)
def join_posts_accounts(spark, sf):
    p = fx.posts(spark, sf).select("id", "username")
    return rel.join_lower_key(p, fx.accounts(spark, sf), "username", "username").select("id", "username", "party", "coalition", "role")


@query(
    "join_on_id",
    with_ctes("posts")
    + "SELECT p.id, p.username AS username_x, d.source AS username_y, p.language, d.n_chars FROM posts p JOIN documents d ON p.id = d.doc_id",
)
def join_on_id(spark, sf):
    p = fx.posts(spark, sf).select("id", "username", "language")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("username"), "n_chars")
    return rel.join_with_suffixes(p, d, "id")


@query(
    "join_right",
    with_ctes("posts", "accounts")
    + ", pa AS (SELECT p.id, a.party FROM posts p JOIN accounts a ON lower(p.username) = lower(a.username)) "
    "SELECT l.doc_id AS id, pa.party, l.quality FROM pa RIGHT JOIN labels l ON pa.id = l.doc_id",
)
def join_right(spark, sf):
    p = fx.posts(spark, sf).select("id", "username")
    pa = rel.join_lower_key(p, fx.accounts(spark, sf), "username", "username").select("id", "party")
    scored = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    return pa.join(scored, "id", "right").select("id", "party", "quality")


@query(
    "join_semi",
    with_ctes("posts")
    + ", keys AS (SELECT DISTINCT username FROM posts WHERE language = 'en' AND length(tweet) > 15000) "
    "SELECT id, username FROM posts WHERE username IN (SELECT username FROM keys)",
)
def join_semi(spark, sf):
    p = fx.posts(spark, sf)
    keys = p.filter((F.col("language") == "en") & (F.length("tweet") > 15000)).select("username").distinct()
    return rel.semi_join(p.select("id", "username"), keys, "username")


@query(
    "join_anti",
    with_ctes("posts", "accounts")
    + "SELECT p.id, p.username FROM posts p WHERE NOT EXISTS (SELECT 1 FROM accounts a WHERE lower(a.username) = lower(p.username))",
)
def join_anti(spark, sf):
    p = fx.posts(spark, sf).select("id", "username")
    return rel.join_lower_key(p, fx.accounts(spark, sf).select("username"), "username", "username", how="left_anti")


# --- positions and previews -----------------------------------------------------
@query("row_position", "SELECT row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos, doc_id FROM documents")
def row_position(spark, sf):
    """Dense 0-based position of every document by length."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    return position_within(d, [], ["n_chars", "doc_id"], out="pos").select("pos", "doc_id")


@query("preview", "SELECT doc_id, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5")
def preview(spark, sf):
    """The five longest documents."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return d.orderBy(F.desc("n_chars"), "doc_id").limit(5)


# --- set operations -------------------------------------------------------------
@query(
    "weighted_union",
    "SELECT conv_id, turn, role, CAST(1.0 AS DOUBLE) AS weight FROM conversations WHERE role = 'user' "
    "UNION ALL SELECT conv_id, turn, role, CAST(10.0 AS DOUBLE) AS weight FROM conversations WHERE role = 'assistant' "
    "UNION ALL SELECT conv_id, turn, role, CAST(5.0 AS DOUBLE) AS weight FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')",
)
def weighted_union(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    rest = F.col("role").isNull() | ~F.col("role").isin("user", "assistant")
    return rel.weighted_union([(c.filter(F.col("role") == "user"), 1.0), (c.filter(F.col("role") == "assistant"), 10.0), (c.filter(rest), 5.0)])


@query("dedup_text", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_text(spark, sf):
    return rel.dedup_on(table(spark, sf, "documents").select("text", "doc_id"), ["text"])


@query("label_union", "SELECT event_type AS label FROM events UNION SELECT role AS label FROM conversations")
def label_union(spark, sf):
    a = table(spark, sf, "events").select(F.col("event_type").alias("label")).distinct()
    b = table(spark, sf, "conversations").select(F.col("role").alias("label")).distinct()
    return rel.union_distinct([a, b])
