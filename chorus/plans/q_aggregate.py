"""Aggregation, report, series, ranking and grid queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.functions import text as tx
from chorus.functions import vectors as vf
from chorus.operators import aggregate as agg
from chorus.operators import corpus, ranking, reports, series
from chorus.operators import relational as rel
from chorus.plans import fixtures as fx
from chorus.plans.fixtures import sql_clean, sql_tokens, with_ctes
from chorus.plans.registry import query, r6
from chorus.session import checkpoint_dir
from chorus.sources.tables import table

_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in fx.STOP_WORDS) + ")"


@query("count_by_user", with_ctes("posts") + "SELECT username, count(id) AS n FROM posts WHERE username IS NOT NULL GROUP BY username")
def count_by_user(spark, sf):
    return agg.count_by_key(fx.posts(spark, sf), "username", "id")


@query("value_counts", with_ctes("posts") + "SELECT language, count(*) AS n FROM posts WHERE language IS NOT NULL GROUP BY language")
def value_counts(spark, sf):
    return agg.value_counts(fx.posts(spark, sf), "language")


@query("class_ratio", with_ctes("posts") + "SELECT round(avg(CASE WHEN language = 'en' THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS ratio FROM posts WHERE language IS NOT NULL")
def class_ratio(spark, sf):
    return agg.class_ratio(fx.posts(spark, sf), "language", "en").select(r6("ratio").alias("ratio"))


@query(
    "party_coalition",
    with_ctes("posts", "accounts")
    + "SELECT a.party, max(a.coalition) AS coalition, max(a.role) AS role FROM posts p JOIN accounts a ON lower(p.username) = lower(a.username) GROUP BY a.party",
)
def party_coalition(spark, sf):
    j = rel.join_lower_key(fx.posts(spark, sf).select("id", "username"), fx.accounts(spark, sf), "username", "username")
    return agg.group_max(j, "party", ["coalition", "role"])


@query(
    "length_stats",
    with_ctes("posts") + f"SELECT CAST(max(length(t)) AS BIGINT) AS max_len, round(avg(length(t)), 6) AS mean_len FROM (SELECT {sql_clean('tweet')} AS t FROM posts)",
)
def length_stats(spark, sf):
    p = fx.posts(spark, sf).select(tx.clean_text("tweet").alias("t"))
    return agg.length_stats(p, "t").select("max_len", r6("mean_len").alias("mean_len"))


@query(
    "describe_counts",
    with_ctes("posts")
    + ", c AS (SELECT CAST(count(id) AS DOUBLE) AS x FROM posts WHERE username IS NOT NULL GROUP BY username) "
    "SELECT count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, "
    "round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max FROM c",
)
def describe_counts(spark, sf):
    c = agg.count_by_key(fx.posts(spark, sf), "username", "id")
    d = agg.describe(c, "n")
    return d.select("count", *[r6(c).alias(c) for c in ("mean", "std")], "min", *[r6(c).alias(c) for c in ("q25", "q50", "q75")], "max")


@query(
    "distinct_dims",
    with_ctes("posts", "accounts")
    + ", j AS (SELECT p.username, p.language, a.party FROM posts p LEFT JOIN accounts a ON lower(p.username) = lower(a.username)) "
    "SELECT 'username' AS \"column\", count(DISTINCT username) AS n_distinct FROM j UNION ALL "
    "SELECT 'language', count(DISTINCT language) FROM j UNION ALL SELECT 'party', count(DISTINCT party) FROM j",
)
def distinct_dims(spark, sf):
    j = rel.join_lower_key(fx.posts(spark, sf).select("username", "language"), fx.accounts(spark, sf), "username", "username", how="left")
    return agg.distinct_counts(j, ["username", "language", "party"])


@query(
    "hist_fixed_width",
    "WITH m AS (SELECT min(CAST(n_chars AS DOUBLE)) AS lo FROM documents) "
    "SELECT CAST(floor((CAST(n_chars AS DOUBLE) - m.lo) / 500.0) AS BIGINT) AS bin, "
    "round(m.lo + CAST(floor((CAST(n_chars AS DOUBLE) - m.lo) / 500.0) AS BIGINT) * 500.0, 6) AS lo, count(*) AS n FROM documents, m GROUP BY 1, 2",
)
def hist_fixed_width(spark, sf):
    h = agg.hist_fixed_width(table(spark, sf, "documents"), "n_chars", 500.0)
    return h.select("bin", r6("lo").alias("lo"), "n")


@query(
    "hist_fixed_bins",
    with_ctes("posts")
    + f", c AS (SELECT CAST(length({sql_clean('tweet')}) AS DOUBLE) AS x FROM posts), m AS (SELECT min(x) AS lo, max(x) AS hi FROM c) "
    "SELECT CAST(CASE WHEN m.hi = m.lo THEN 0 ELSE least(floor((x - m.lo) / ((m.hi - m.lo) / 200.0)), 199) END AS BIGINT) AS bin, count(*) AS n FROM c, m GROUP BY 1",
)
def hist_fixed_bins(spark, sf):
    p = fx.posts(spark, sf).select(tx.text_length(tx.clean_text("tweet")).alias("x"))
    return agg.hist_fixed_bins(p, "x", 200)


@query(
    "box_summary",
    "SELECT o_orderstatus, o_orderpriority, round(min(o_totalprice), 6) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, "
    "round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, round(max(o_totalprice), 6) AS max "
    "FROM orders GROUP BY 1, 2",
)
def box_summary(spark, sf):
    b = agg.box_summary(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice")
    return b.select("o_orderstatus", "o_orderpriority", *[r6(c).alias(c) for c in ("min", "q1", "median", "q3", "max")])


@query(
    "run_average",
    "SELECT o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 6) AS mean_o_totalprice, count(*) AS runs FROM orders GROUP BY 1, 2",
)
def run_average(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", F.year("o_orderdate").alias("year"), "o_totalprice")
    r = agg.run_average(o, ["o_orderpriority", "year"], ["o_totalprice"])
    return r.select("o_orderpriority", "year", r6("mean_o_totalprice").alias("mean_o_totalprice"), "runs")


_SQL_BEST = (
    "WITH s AS (SELECT o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 6) AS score "
    "FROM orders GROUP BY 1, 2, 3), b AS (SELECT o_orderstatus, max(score) AS best FROM s GROUP BY 1) "
    "SELECT s.o_orderstatus, min(s.o_orderpriority) AS o_orderpriority, min(s.year) AS year, max(s.score) AS score FROM s JOIN b "
    "ON s.o_orderstatus = b.o_orderstatus AND s.score = b.best GROUP BY 1"
)


@query("best_config", _SQL_BEST)
def best_config(spark, sf):
    o = table(spark, sf, "orders")
    s = o.groupBy("o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year")).agg(r6(F.avg("o_totalprice")).alias("score"))
    return agg.best_config(s, ["o_orderstatus"], ["o_orderpriority", "year"], "score")


# Fixed values of the parameter grid fixture
GRID_LR = [0.1, 0.01, 0.001]
GRID_WEIGHT = [1, 5, 10, 15]


@query(
    "param_grid",
    "WITH s AS (SELECT r.r_name, avg(o.o_totalprice) AS base FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
    "JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name) "
    "SELECT r_name, lr, weight, round(base * lr / weight, 6) AS score FROM s, (SELECT unnest([0.1, 0.01, 0.001]::DOUBLE[]) AS lr) l, "
    "(SELECT unnest([1, 5, 10, 15]) AS weight) w",
)
def param_grid(spark, sf):
    """Parameter cross product as generators (no join): every region row expands to
    the product of the literal lists; each grid row is scored from the region's orders."""
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    geo = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    geo = geo.select(F.col("n_nationkey").alias("c_nationkey"), "r_name")  # 25 rows
    base = o.join(c, "o_custkey").join(geo, "c_nationkey").groupBy("r_name").agg(F.avg("o_totalprice").alias("_base"))
    g = base.select("r_name", "_base", F.explode(F.array(*[F.lit(x) for x in GRID_LR])).alias("lr"))
    g = g.select("r_name", "_base", "lr", F.explode(F.array(*[F.lit(x) for x in GRID_WEIGHT])).alias("weight"))
    return g.select("r_name", "lr", "weight", r6(F.col("_base") * F.col("lr") / F.col("weight")).alias("score"))


_SQL_WIDE = (
    "WITH r AS (SELECT c_nationkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) "
    "SELECT c_nationkey, "
    + ", ".join(f"max(CASE WHEN rn = {i + 1} THEN c_name END) AS acc_{i}, max(CASE WHEN rn = {i + 1} THEN c_mktsegment END) AS ver_{i}" for i in range(3))
    + " FROM r WHERE rn <= 3 GROUP BY c_nationkey"
)


@query("top_n_wide", _SQL_WIDE)
def top_n_wide(spark, sf):
    c = table(spark, sf, "customer")
    return ranking.top_n_wide(c, "c_nationkey", [F.desc("c_acctbal"), F.asc("c_custkey")], 3, {"acc": "c_name", "ver": "c_mktsegment"})


# --- series -------------------------------------------------------------------
@query(
    "series_delta",
    with_ctes("run_histories")
    + "SELECT a.run, a.epoch, round(a.score - b.score, 6) AS delta FROM run_histories a JOIN run_histories b ON a.run = b.run AND a.epoch = b.epoch + 1",
)
def series_delta(spark, sf):
    h = fx.run_histories(spark, sf)
    return series.series_delta(h, "run", "epoch", "score").select("run", "epoch", r6("delta").alias("delta"))


_SQL_EARLY = (
    with_ctes("run_histories")
    + """, h AS (SELECT run, epoch, score,
    max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best FROM run_histories),
i AS (SELECT *, max(CASE WHEN prev_best IS NULL OR score > prev_best THEN epoch END)
    OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp FROM h),
s AS (SELECT run, min(CASE WHEN epoch - last_imp >= 10 THEN epoch END) AS stop_epoch, max(epoch) AS maxe FROM i GROUP BY run)
SELECT s.run, s.stop_epoch, i.last_imp AS best_epoch, round(b.score, 6) AS best_value, i.epoch AS epochs
FROM s JOIN i ON s.run = i.run AND i.epoch = COALESCE(s.stop_epoch, s.maxe)
JOIN run_histories b ON b.run = i.run AND b.epoch = i.last_imp"""
)


@query("early_stop", _SQL_EARLY)
def early_stop(spark, sf):
    h = fx.run_histories(spark, sf)
    e = series.early_stop(h, "run", "epoch", "score", patience=10, mode="max")
    return e.select("run", "stop_epoch", "best_epoch", r6("best_value").alias("best_value"), "epochs")


@query(
    "run_filter",
    with_ctes("run_histories")
    + ", s AS (SELECT run FROM run_histories GROUP BY run HAVING max_by(score, epoch) >= 20 AND max(score) >= 300) "
    "SELECT run, epoch, score FROM run_histories WHERE run IN (SELECT run FROM s)",
)
def run_filter(spark, sf):
    h = fx.run_histories(spark, sf)
    return series.run_filter(h, "run", "epoch", "score", min_last=20.0, min_max=300.0)


# --- share reports ------------------------------------------------------------
def _sql_label_share() -> str:
    labs = ", ".join(f"('{x}')" for x in fx.SHARE_LABELS)
    parts = []
    for d in ("user", "party", "coalition"):
        parts.append(f"SELECT '{d}' AS dim, \"{d}\" AS key, label FROM share_events WHERE \"{d}\" IS NOT NULL AND label IS NOT NULL")
    return (
        with_ctes("share_events")
        + ", e AS ("
        + " UNION ALL ".join(parts)
        + "), tot AS (SELECT dim, key, count(*) AS n_all FROM e GROUP BY 1, 2), cnt AS (SELECT dim, key, label, count(*) AS n FROM e GROUP BY 1, 2, 3) "
        f"SELECT t.dim, t.key, l.label, round(COALESCE(c.n, 0) / t.n_all, 6) AS share FROM tot t CROSS JOIN (VALUES {labs}) l(label) "
        "LEFT JOIN cnt c ON c.dim = t.dim AND c.key = t.key AND c.label = l.label"
    )


@query("label_share_by_dim", _sql_label_share())
def label_share_by_dim(spark, sf):
    e = fx.share_events(spark, sf)
    s = reports.label_share_by_dim(e, ["user", "party", "coalition"], "label", fx.SHARE_LABELS)
    return s.select("dim", "key", "label", r6("share").alias("share"))


def _topic_dims_sql() -> str:
    return (
        with_ctes("topic_long")
        + ", t AS (SELECT CAST(label AS VARCHAR) AS lab, 'P' || CAST(vec_id % 4 AS VARCHAR) AS grp, topic, p FROM topic_long)"
    )


@query(
    "topic_share_by_dim",
    _topic_dims_sql()
    + ", e AS (SELECT 'lab' AS dim, lab AS key, topic, p FROM t UNION ALL SELECT 'grp', grp, topic, p FROM t), "
    "s AS (SELECT dim, key, topic, sum(p) AS sp FROM e GROUP BY 1, 2, 3) "
    "SELECT dim, key, CAST(topic AS BIGINT) AS topic, round(sp / sum(sp) OVER (PARTITION BY dim, key), 6) AS share FROM s",
)
def topic_share_by_dim(spark, sf):
    d = fx.topic_distributions(spark, sf).select(
        F.col("label").cast("string").alias("lab"), F.concat(F.lit("P"), (F.col("vec_id") % 4).cast("string")).alias("grp"), "dist"
    )
    s = reports.topic_share_by_dim(d, ["lab", "grp"], "dist")
    return s.select("dim", "key", "topic", r6("share").alias("share"))


@query(
    "topic_share_total",
    with_ctes("topic_long")
    + ", s AS (SELECT topic, sum(p) AS sp FROM topic_long GROUP BY topic) SELECT CAST(topic AS BIGINT) AS topic, round(sp / (SELECT sum(sp) FROM s), 6) AS share FROM s",
)
def topic_share_total(spark, sf):
    s = reports.topic_share_total(fx.topic_distributions(spark, sf), "dist")
    return s.select("topic", r6("share").alias("share"))


# --- corpus terms ---------------------------------------------------------------
def _sql_vocab(base: str, n: int = 1000) -> str:
    """Vocabulary SQL over a relation ``base(id, t)``: df >= 2, top n by count, stop words out."""
    return (
        f"tok AS (SELECT id, unnest({sql_tokens('t')}) AS term FROM {base}), "
        "ts AS (SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM tok GROUP BY term), "
        f"vocab AS (SELECT term, n, df FROM (SELECT * FROM ts WHERE df >= 2 ORDER BY n DESC, term ASC LIMIT {n}) WHERE term NOT IN {_STOP_SQL})"
    )


@query(
    "term_frequencies",
    "WITH base AS (SELECT doc_id AS id, text AS t FROM documents), " + _sql_vocab("base") + " SELECT term, n, df FROM vocab",
)
def term_frequencies(spark, sf):
    d = table(spark, sf, "documents")
    return corpus.term_frequencies(d, "text", "doc_id", stop_words=fx.STOP_WORDS)


def _sql_term_counts() -> str:
    return (
        with_ctes("posts", "accounts")
        + f", c AS (SELECT id, username, {sql_clean('tweet')} AS t FROM posts WHERE length({sql_clean('tweet')}) >= 10), "
        "act AS (SELECT * FROM c WHERE username IS NULL OR username NOT IN (SELECT username FROM c WHERE username IS NOT NULL GROUP BY username HAVING count(id) < 5)), "
        "j AS (SELECT act.id, lower(act.username) AS username, a.party, a.coalition, act.t FROM act JOIN accounts a ON lower(act.username) = lower(a.username)), "
        + _sql_vocab("j")
        + ", kt AS (SELECT j.username, j.party, j.coalition, tok.term, count(*) AS n FROM j JOIN tok ON j.id = tok.id JOIN vocab v ON tok.term = v.term GROUP BY 1, 2, 3, 4), "
        "g AS (SELECT 'username' AS dim, username AS key, term, sum(n) AS n FROM kt GROUP BY 1, 2, 3 UNION ALL "
        "SELECT 'party', party, term, sum(n) FROM kt GROUP BY 1, 2, 3 UNION ALL SELECT 'coalition', coalition, term, sum(n) FROM kt GROUP BY 1, 2, 3), "
        "k AS (SELECT 'username' AS dim, username AS key FROM j UNION SELECT 'party', party FROM j UNION SELECT 'coalition', coalition FROM j) "
        "SELECT k.dim, k.key, v.term, CAST(COALESCE(g.n, 0) AS BIGINT) AS n FROM k CROSS JOIN vocab v "
        "LEFT JOIN g ON g.dim = k.dim AND g.key = k.key AND g.term = v.term"
    )


def flagship(spark, sf):
    """posts -> clean -> length >= 10 -> minimum activity -> accounts -> tokens -> vocabulary
    (top 1000, df >= 2, stop words out) -> dense counts per user, party and coalition."""
    p = tx.with_clean(fx.posts(spark, sf).select("id", "username", "tweet"), "tweet", "t").select("id", "username", "t")
    checkpoint_dir(spark)
    p = p.filter(tx.text_length("t") >= 10).checkpoint()  # read twice: activity and terms
    p = rel.min_activity(p, "username", "id", 5)
    acc = fx.accounts(spark, sf).select(F.lower("username").alias("username"), "party", "coalition")
    p = p.withColumn("username", F.lower("username"))
    # the vocabulary is computed over the posts that have an account, like the oracle
    p = p.join(acc.select("username"), "username", "left_semi")
    return corpus.term_counts_by_dim(p, "t", "id", "username", acc, ["party", "coalition"], stop_words=fx.STOP_WORDS)


query("term_counts_by_dim", _sql_term_counts())(flagship)


@query(
    "topic_subset_terms",
    "WITH " + fx.SQL_CTES["topic_long"]
    + ", top AS (SELECT vec_id, arg_max(topic, p) AS topic FROM (SELECT vec_id, topic, p FROM topic_long) GROUP BY vec_id), "
    "nv AS (SELECT count(*) AS c FROM embeddings), "
    "tok AS (SELECT t.topic, d.doc_id, unnest(" + sql_tokens("d.text") + ") AS term FROM documents d, nv JOIN top t ON d.doc_id % nv.c = t.vec_id), "
    "c AS (SELECT topic, term, count(*) AS n, count(DISTINCT doc_id) AS df FROM tok GROUP BY 1, 2) "
    "SELECT CAST(topic AS BIGINT) AS topic, term, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS BIGINT) AS rank FROM c WHERE df >= 2) "
    "WHERE rank <= 1000 AND term NOT IN " + _STOP_SQL,
)
def topic_subset_terms(spark, sf):
    """Vocabulary (df >= 2, 1000 most frequent, stop words out) of the texts whose top topic is
    k, for every k.  Every document takes the vector of its id modulo the number of vectors."""
    e = fx.topic_distributions(spark, sf)
    t = e.select("vec_id", vf.argmax("dist").alias("topic"))
    d = table(spark, sf, "documents").select("doc_id", "text").withColumn("_n", e.agg(F.count(F.lit(1))).scalar())
    d = d.withColumn("vec_id", F.col("doc_id") % F.col("_n")).join(t, "vec_id")
    c = corpus.key_term_counts(d, "text", "topic").where(F.col("df") >= 2)
    top = ranking.top_n_per_key(c, ["topic"], [F.desc("n"), F.asc("term")], 1000, "rank")
    return top.where(~F.col("term").isin(*fx.STOP_WORDS)).select("topic", "term", "n", "rank")
