"""Evaluation and agreement queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.functions import vectors as vf
from chorus.operators import agreement, evaluate
from chorus.plans import fixtures as fx
from chorus.plans.fixtures import with_ctes
from chorus.plans.registry import query, r6

LABELS10 = [f"c{i}" for i in range(10)]


def _sql_class_counts(rel: str) -> str:
    return (
        f"lab AS (SELECT truth AS label FROM {rel} UNION SELECT pred FROM {rel}), "
        "pc AS (SELECT l.label, "
        f"(SELECT count(*) FROM {rel} p WHERE p.truth = l.label AND p.pred = l.label) AS tp, "
        f"(SELECT count(*) FROM {rel} p WHERE p.pred = l.label AND p.truth <> l.label) AS fp, "
        f"(SELECT count(*) FROM {rel} p WHERE p.truth = l.label AND p.pred <> l.label) AS fn, "
        f"(SELECT count(*) FROM {rel} p WHERE p.truth = l.label) AS support FROM lab l), "
        "sc AS (SELECT label, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, "
        "CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, "
        "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1, support, tp FROM pc)"
    )


@query(
    "macro_f1",
    with_ctes("predictions", "predictions2")
    + ", "
    + _sql_class_counts("predictions").replace("lab AS", "lab1 AS").replace("FROM lab l", "FROM lab1 l").replace("pc AS", "pc1 AS").replace("FROM pc)", "FROM pc1)").replace("sc AS", "sc1 AS")
    + ", "
    + _sql_class_counts("predictions2").replace("lab AS", "lab2 AS").replace("FROM lab l", "FROM lab2 l").replace("pc AS", "pc2 AS").replace("FROM pc)", "FROM pc2)").replace("sc AS", "sc2 AS")
    + " SELECT 'base' AS variant, round(avg(f1), 6) AS macro_f1, count(*) AS n_labels FROM sc1 "
    "UNION ALL SELECT 'variant', round(avg(f1), 6), count(*) FROM sc2",
)
def macro_f1(spark, sf):
    a = evaluate.macro_f1(fx.predictions(spark, sf), "truth", "pred").select(F.lit("base").alias("variant"), "macro_f1", "n_labels")
    b = evaluate.macro_f1(fx.predictions(spark, sf, variant=True), "truth", "pred").select(F.lit("variant").alias("variant"), "macro_f1", "n_labels")
    return a.unionByName(b).select("variant", r6("macro_f1").alias("macro_f1"), "n_labels")


@query(
    "classification_report",
    with_ctes("predictions2")
    + ", "
    + _sql_class_counts("predictions2")
    + """, tot AS (SELECT sum(support) AS s, sum(tp) AS t FROM sc)
SELECT label AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM sc
UNION ALL SELECT 'accuracy', NULL, NULL, round(t / s, 6), CAST(s AS BIGINT) FROM tot
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST((SELECT s FROM tot) AS BIGINT) FROM sc
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / (SELECT s FROM tot), 6), round(sum(recall * support) / (SELECT s FROM tot), 6),
  round(sum(f1 * support) / (SELECT s FROM tot), 6), CAST((SELECT s FROM tot) AS BIGINT) FROM sc""",
)
def classification_report(spark, sf):
    r = evaluate.classification_report(fx.predictions(spark, sf, variant=True), "truth", "pred")
    return r.select("row", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "confusion_matrix",
    with_ctes("predictions2")
    + ", lab AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{x}')" for x in LABELS10)
    + ") t(truth)) SELECT lab.truth, "
    + ", ".join(f"CAST(count(CASE WHEN p.pred = '{x}' THEN 1 END) AS BIGINT) AS {x}" for x in LABELS10)
    + " FROM lab LEFT JOIN predictions2 p ON p.truth = lab.truth GROUP BY lab.truth",
)
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(fx.predictions(spark, sf, variant=True), "truth", "pred", LABELS10)


@query(
    "misclassified",
    "WITH "
    + fx.SQL_CTES["topic_long"]
    + ", top AS (SELECT vec_id, arg_max(topic, p) AS topic, max(p) AS proba, any_value(label) AS label FROM topic_long GROUP BY vec_id) "
    "SELECT vec_id AS item, 'c' || CAST(label AS VARCHAR) AS truth, 'c' || CAST(topic AS VARCHAR) AS pred, round(proba, 6) AS proba FROM top "
    "WHERE 'c' || CAST(label AS VARCHAR) <> 'c' || CAST(topic AS VARCHAR)",
)
def misclassified(spark, sf):
    """Rows whose label differs from the arg-max of their class distribution, with its
    probability."""
    d = fx.topic_distributions(spark, sf).select(
        F.col("vec_id").alias("item"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("truth"),
        F.concat(F.lit("c"), vf.argmax("dist").cast("string")).alias("pred"),
        r6(F.array_max("dist")).alias("proba"),
    )
    return evaluate.misclassified(d, "truth", "pred")


RATERS = ["r1", "r2", "r3", "r4"]


def _sql_kappa() -> str:
    pairs = [(a, b) for i, a in enumerate(RATERS) for b in RATERS[i + 1:]]
    long = " UNION ALL ".join(f"SELECT item, '{r}' AS coder, COALESCE({r}, 'nan') AS label FROM annotations" for r in RATERS)
    ao = " UNION ALL ".join(
        f"SELECT '{a}' AS coder_a, '{b}' AS coder_b, avg(CASE WHEN COALESCE({a}, 'nan') = COALESCE({b}, 'nan') THEN 1.0 ELSE 0.0 END) AS ao FROM annotations"
        for a, b in pairs
    )
    return (
        with_ctes("annotations")
        + f", lg AS ({long}), n AS (SELECT count(*) AS n FROM annotations), fr AS (SELECT coder, label, count(*) AS c FROM lg GROUP BY 1, 2), "
        "ae AS (SELECT a.coder AS coder_a, b.coder AS coder_b, sum(a.c * b.c) / (SELECT n * n FROM n) AS ae FROM fr a JOIN fr b ON a.label = b.label AND a.coder < b.coder GROUP BY 1, 2), "
        f"ao AS ({ao}), k AS (SELECT ao.coder_a, ao.coder_b, ao.ao, COALESCE(ae.ae, 0.0) AS ae FROM ao LEFT JOIN ae ON ao.coder_a = ae.coder_a AND ao.coder_b = ae.coder_b) "
    )


@query(
    "kappa_pairwise",
    _sql_kappa() + "SELECT coder_a, coder_b, round(ao, 6) AS ao, round(ae, 6) AS ae, round((ao - ae) / (1.0 - ae), 6) AS kappa FROM k",
)
def kappa_pairwise(spark, sf):
    k = agreement.kappa_pairwise(fx.annotations(spark, sf), RATERS)
    return k.select("coder_a", "coder_b", *[r6(c).alias(c) for c in ("ao", "ae", "kappa")])


@query("kappa_mean", _sql_kappa() + "SELECT round(avg((ao - ae) / (1.0 - ae)), 6) AS kappa, count(*) AS pairs FROM k")
def kappa_mean(spark, sf):
    k = agreement.kappa_mean(fx.annotations(spark, sf), RATERS)
    return k.select(r6("kappa").alias("kappa"), "pairs")
