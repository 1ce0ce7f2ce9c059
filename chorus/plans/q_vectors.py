"""Vector queries: parse, means, scaling, distances, all-pairs histogram, KNN,
word-vector features."""

from __future__ import annotations

from pyspark.sql import functions as F

from chorus.functions import vectors as vf
from chorus.operators import corpus
from chorus.operators import vectors as vo
from chorus.operators.ranking import position_within
from chorus.plans import fixtures as fx
from chorus.plans.fixtures import with_ctes
from chorus.plans.registry import query, r6
from chorus.session import checkpoint_dir
from chorus.sources.tables import table

_LONG = "SELECT {key}, CAST(dim AS BIGINT) AS dim, round({val}, 6) AS value FROM {rel}"


def _long(df, keys):
    return vo.explode_vector(df, keys, "vec").select(*keys, "dim", r6("value").alias("value"))


@query("vector_text_parse", with_ctes("vec_long") + _LONG.format(key="vec_id", val="x", rel="vec_long"))
def vector_text_parse(spark, sf):
    """Vectors written as ``[x y ...]`` text (one variant with a line break inside),
    parsed back with a width check."""
    v = fx.vectors(spark, sf)
    txt = F.regexp_replace(vf.vector_to_text("vec"), " ", F.when(F.col("vec_id") % 2 == 0, F.lit(" ")).otherwise(F.lit("\n ")))
    parsed = v.select("vec_id", vf.parse_vector_text(txt, width=64).alias("vec"))
    return _long(parsed, ["vec_id"])


@query(
    "mean_vector_by_key",
    with_ctes("vec_long") + "SELECT label, CAST(dim AS BIGINT) AS dim, round(avg(x), 6) AS value FROM vec_long GROUP BY label, dim",
)
def mean_vector_by_key(spark, sf):
    m = vo.mean_vector_by_key(fx.vectors(spark, sf), "label", "vec")
    return _long(m, ["label"])


@query(
    "argmax_vector",
    with_ctes("topic_long") + "SELECT vec_id, CAST(arg_max(topic, p) AS BIGINT) AS topic, round(max(p), 6) AS proba FROM topic_long GROUP BY vec_id",
)
def argmax_vector(spark, sf):
    d = fx.topic_distributions(spark, sf)
    return d.select("vec_id", vf.argmax("dist").alias("topic"), r6(F.array_max("dist")).alias("proba"))


@query(
    "l2_normalise",
    with_ctes("vec_long")
    + ", nr AS (SELECT vec_id, sqrt(sum(x * x)) AS nrm FROM vec_long GROUP BY vec_id) "
    "SELECT v.vec_id, CAST(v.dim AS BIGINT) AS dim, round(CASE WHEN nr.nrm = 0 THEN 0.0 ELSE v.x / nr.nrm END, 6) AS value FROM vec_long v JOIN nr ON v.vec_id = nr.vec_id",
)
def l2_normalise(spark, sf):
    v = fx.vectors(spark, sf).select("vec_id", vf.l2_normalise("vec").alias("vec"))
    return _long(v, ["vec_id"])


@query(
    "standardise",
    with_ctes("vec_long")
    + ", st AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM vec_long GROUP BY dim) "
    "SELECT v.vec_id, CAST(v.dim AS BIGINT) AS dim, round((v.x - st.m) / CASE WHEN st.s = 0 THEN 1.0 ELSE st.s END, 6) AS value FROM vec_long v JOIN st ON v.dim = st.dim",
)
def standardise(spark, sf):
    return _long(vo.standardise(fx.vectors(spark, sf), "vec"), ["vec_id"])


@query(
    "minmax_scale",
    with_ctes("vec_long")
    + ", st AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM vec_long GROUP BY dim) "
    "SELECT v.vec_id, CAST(v.dim AS BIGINT) AS dim, round(CASE WHEN st.hi = st.lo THEN 0.0 ELSE (v.x - st.lo) / (st.hi - st.lo) END, 6) AS value FROM vec_long v JOIN st ON v.dim = st.dim",
)
def minmax_scale(spark, sf):
    return _long(vo.minmax_scale(fx.vectors(spark, sf), "vec"), ["vec_id"])


@query(
    "one_hot",
    with_ctes("predictions")
    + ", cl AS (SELECT list_sort(list(DISTINCT truth)) AS classes FROM predictions) "
    "SELECT item, truth, array_to_string(list_transform(classes, lambda c: CASE WHEN c = truth THEN '1' ELSE '0' END), ',') AS code, "
    "classes[list_position(list_transform(classes, lambda c: CASE WHEN c = truth THEN 1 ELSE 0 END), 1)] AS decoded FROM predictions, cl",
)
def one_hot(spark, sf):
    """Labels one-hot over the sorted class list (a scalar subquery: bounded by the
    number of classes) and decoded back by arg-max."""
    p = fx.predictions(spark, sf)
    p = p.withColumn("_classes", p.agg(F.array_sort(F.collect_set("truth"))).scalar())
    classes = F.col("_classes")
    code = vf.one_hot("truth", classes)
    return p.select(
        "item",
        "truth",
        F.array_join(F.transform(code, lambda x: x.cast("string")), ",").alias("code"),
        vf.inverse_one_hot(code, classes).alias("decoded"),
    )


@query(
    "vector_distance",
    with_ctes("vec_long")
    + ", m AS (SELECT label, dim, avg(x) AS mx FROM vec_long GROUP BY 1, 2), d AS (SELECT v.vec_id, v.x - m.mx AS df FROM vec_long v JOIN m ON v.label = m.label AND v.dim = m.dim) "
    "SELECT vec_id, round(sqrt(sum(df * df)), 6) AS euclidean, round(sum(abs(df)), 6) AS manhattan, round(max(abs(df)), 6) AS chebyshev, "
    "round(sqrt(sum(df * df)), 6) AS minkowski FROM d GROUP BY vec_id",
)
def vector_distance(spark, sf):
    """Distance of every vector to the mean vector of its label, in four metrics."""
    v = fx.vectors(spark, sf)
    m = vo.mean_vector_by_key(v, "label", "vec", out="mean")
    j = v.join(m, "label")
    return j.select(
        "vec_id",
        *[r6(vf.distance("vec", "mean", metric)).alias(metric) for metric in ("euclidean", "manhattan", "chebyshev", "minkowski")],
    )


@query(
    "pairwise_distance_hist",
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) "
    "SELECT CAST(floor(sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) / 0.05) AS BIGINT) AS bin, count(*) AS n "
    "FROM v a, v b GROUP BY 1",
)
def pairwise_distance_hist(spark, sf):
    return vo.pairwise_distance_hist(fx.vectors(spark, sf), "vec_id", "vec", width=0.05, block_rows=256)


_SQL_KNN = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
d AS (SELECT q.vec_id AS qid, t.vec_id AS tid, t.label,
  list_sum(list_transform(list_zip(q.e, t.e), lambda z: abs(z[1] - z[2]))) AS dist FROM v q, v t WHERE q.vec_id <> t.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d),
vt AS (SELECT qid, label, count(*) AS c FROM r WHERE rn <= 5 GROUP BY 1, 2),
b AS (SELECT qid, max(c) AS m FROM vt GROUP BY 1)
SELECT vt.qid AS vec_id, min(vt.label) AS pred FROM vt JOIN b ON vt.qid = b.qid AND vt.c = b.m GROUP BY vt.qid"""


@query("knn_classify", _SQL_KNN)
def knn_classify(spark, sf):
    """Leave-one-out 5 nearest neighbours (Manhattan), uniform vote, for every vector."""
    v = fx.vectors(spark, sf)
    return vo.knn_classify(v, v, "vec_id", "vec", "label", k=5, metric="manhattan", weights="uniform", exclude_self=True)


_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in fx.STOP_WORDS) + ")"

_SQL_WORDVEC = (
    "WITH tok AS (SELECT doc_id, unnest("
    + fx.sql_tokens("text")
    + ") AS term FROM documents), "
    "ts AS (SELECT term, count(*) AS n, count(DISTINCT doc_id) AS df FROM tok GROUP BY term), "
    f"vocab AS (SELECT term, n FROM (SELECT * FROM ts WHERE df >= 2) WHERE term NOT IN {_STOP_SQL}), "
    "ranked AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) - 1 AS r FROM vocab), "
    "nv AS (SELECT count(*) AS c FROM embeddings), "
    "wv AS (SELECT ranked.term, e.embedding FROM ranked, nv JOIN embeddings e ON e.vec_id = ranked.r % nv.c), "
    "hits AS (SELECT tok.doc_id, wv.embedding FROM tok JOIN wv ON tok.term = wv.term), "
    "lg AS (SELECT doc_id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS x FROM hits, range(1, len(embedding) + 1) r(i)) "
    "SELECT doc_id, CAST(dim AS BIGINT) AS dim, round(avg(x), 6) AS value FROM lg GROUP BY doc_id, dim"
)


@query("mean_word_vectors", _SQL_WORDVEC)
def mean_word_vectors(spark, sf):
    """Document features = mean of the vectors of its known words.  The word-vector
    table pairs the i-th vocabulary term (by frequency) with vector i mod n."""
    d = table(spark, sf, "documents")
    vocab = corpus.term_frequencies(d, "text", "doc_id", stop_words=fx.STOP_WORDS, max_features=None)
    ranked = position_within(vocab, [], [F.desc("n"), F.asc("term")], out="r")
    e = fx.vectors(spark, sf).select("vec_id", "vec")
    ranked = ranked.withColumn("_n", e.agg(F.count(F.lit(1))).scalar()).select("term", (F.col("r") % F.col("_n")).alias("vec_id"))
    checkpoint_dir(spark)
    wv = ranked.join(e, "vec_id").select("term", "vec").checkpoint()
    return _long(vo.mean_word_vectors(d, "doc_id", "text", wv), ["doc_id"])
