"""Sampling, topic model, classifiers, clustering, projection, encoding and the
composed scored-post query.  These are checked by invariants (tests/), not by an
exact oracle: model fits are not value-equal across implementations."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from chorus.functions import text as tx
from chorus.operators import classify, cluster, density, encode, evaluate, sampling, topics
from chorus.operators import relational as rel
from chorus.operators import vectors as vo
from chorus.plans import fixtures as fx
from chorus.plans.fixtures import with_ctes
from chorus.plans.registry import query, r6
from chorus.session import even_parts, scratch_path
from chorus.sources.tables import table

# Sentiment classes of the labelled-document fixture
#   (quality, toxic) = (1, 0) positive, (0, 1) negative, (0, 0) neutral, (1, 1) ambiguous
def sentiment_label():
    q, t = F.col("quality"), F.col("toxic")
    return (
        F.when((q == 1) & (t == 0), F.lit("positive"))
        .when((q == 0) & (t == 1), F.lit("negative"))
        .when((q == 0) & (t == 0), F.lit("neutral"))
        .otherwise(F.lit("ambiguous"))
    )


def labelled_texts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    lab = table(spark, sf, "labels").select("doc_id", sentiment_label().alias("label"), (1 + 9 * F.col("toxic")).cast("double").alias("weight"))
    return d.join(lab, "doc_id")


# --- sampling -----------------------------------------------------------------------
_SQL_SAMPLE = with_ctes("posts") + (
    "SELECT username, CAST(i AS BIGINT) AS draw, arg_min(id, md5(CAST(id AS VARCHAR) || ':' || CAST(i AS VARCHAR) || ':42')) AS id "
    "FROM posts, range(0, 2) r(i) WHERE username IS NOT NULL GROUP BY username, i"
)


@query("sample_per_key", _SQL_SAMPLE)
def sample_per_key(spark, sf):
    """Two posts per user, drawn with replacement, seeded."""
    return sampling.sample_per_key(fx.posts(spark, sf), "username", "id", n=2, seed=42)


_SQL_LABELLED = """labelled AS (SELECT l.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'positive' WHEN quality = 0 AND toxic = 1 THEN 'negative'
  WHEN quality = 0 AND toxic = 0 THEN 'neutral' ELSE 'ambiguous' END AS label, 1 + 9 * toxic AS weight
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
_SQL_SPLIT = "WITH " + _SQL_LABELLED + """,
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1 AS pos,
  count(*) OVER (PARTITION BY label) AS n FROM labelled)
SELECT doc_id, label, CASE WHEN pos < round(n * 0.8::DOUBLE) THEN 'train' WHEN pos < round(n * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r"""


@query("stratified_split", _SQL_SPLIT)
def stratified_split(spark, sf):
    """0.8 / 0.1 / 0.1 split of the labelled texts, exact per label."""
    return sampling.stratified_split(labelled_texts(spark, sf).select("doc_id", "label"), "label", "doc_id")


@query(
    "stratified_folds",
    "SELECT vec_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42'), vec_id) - 1) % 10 AS INTEGER) AS fold FROM embeddings",
)
def stratified_folds(spark, sf):
    """Ten stratified folds of the vectors by label."""
    return sampling.stratified_folds(fx.vectors(spark, sf).select("vec_id", "label"), "label", "vec_id", k=10)


_SQL_BOOTSTRAP = "WITH " + _SQL_LABELLED + """,
c AS (SELECT doc_id, sum(weight * 1000000) OVER (ORDER BY doc_id) AS hi, weight * 1000000 AS w FROM labelled),
t AS (SELECT max(hi) AS total, count(*) AS n FROM c),
d AS (SELECT i AS draw, CAST(floor(('0x' || substr(md5(CAST(i AS VARCHAR) || ':42'), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE * total::DOUBLE) AS BIGINT) AS x
  FROM t, range(0, (SELECT n FROM t)) r(i))
SELECT d.draw, c.doc_id FROM d ASOF JOIN (SELECT doc_id, hi - w AS lo FROM c) c ON d.x >= c.lo"""


@query("weighted_bootstrap", _SQL_BOOTSTRAP)
def weighted_bootstrap(spark, sf):
    """As many draws as rows, probability proportional to weight (toxic rows x10)."""
    lt = labelled_texts(spark, sf)
    return sampling.weighted_bootstrap(lt, "doc_id", "weight", n=lt.count(), seed=42)


# --- topic model --------------------------------------------------------------------
def _lda(spark, sf) -> tuple[PipelineModel, object]:
    p = tx.with_clean(even_parts(fx.posts(spark, sf).select("id", "tweet")), "tweet", "t").select("id", "t")
    # read by the vocabulary, the fit and the scoring
    p = topics.tokens(p, "t").filter(F.size("tokens") > 0).select("id", "tokens").checkpoint()
    return topics.fit_lda(p, "tokens", k=10, max_iter=100, seed=42), p


@query("lda_topics")
def lda_topics(spark, sf):
    """Ten topics over the cleaned posts: top 10 terms and weights per topic."""
    model, _ = _lda(spark, sf)
    return topics.topic_words(model, spark).filter(F.col("rank") <= 10)


@query("topic_words")
def topic_words(spark, sf):
    """Every vocabulary term of every topic, by weight."""
    model, _ = _lda(spark, sf)
    return topics.topic_words(model, spark)


@query("post_topics")
def post_topics(spark, sf):
    model, p = _lda(spark, sf)
    return topics.post_topics(model, p, "id").select("id", "topic", r6("topic_proba").alias("topic_proba"))


# --- classifiers --------------------------------------------------------------------
def _text_model(spark, sf):
    lt = labelled_texts(spark, sf)
    split = sampling.stratified_split(lt.select("doc_id", "label"), "label", "doc_id").select("doc_id", "split")
    # the joins run once, not in every pass of the fit and of its users
    lt = classify.text_features(even_parts(lt.join(split, "doc_id")).checkpoint(), "text", n_max=2)
    model = classify.fit_text_classifier(lt.filter(F.col("split") == "train"), "grams", "label", weight="weight")
    return model, lt


@query("train_text_classifier")
def train_text_classifier(spark, sf):
    """n-gram (1..2) hashing + multinomial logistic regression, weighted; macro F1 per split."""
    model, lt = _text_model(spark, sf)
    pred = classify.predict_labels(model, lt, ["doc_id", "label", "split"]).checkpoint()
    rows = []
    for split in ("train", "val", "test"):
        part = pred.filter(F.col("split") == split)
        r = evaluate.macro_f1(part, "label", "pred").first()
        rows.append((split, float(r["macro_f1"] or 0.0), part.count()))
    return spark.createDataFrame(rows, "split string, macro_f1 double, n long")


@query("post_sentiment")
def post_sentiment(spark, sf):
    """The text classifier scores every post: top label and probability, joined back on id."""
    model, _ = _text_model(spark, sf)
    posts = even_parts(fx.posts(spark, sf).select("id", "tweet")).select("id", tx.clean_text("tweet").alias("t"))
    posts = classify.text_features(posts, "t", n_max=2)
    scored = classify.predict_labels(model, posts.withColumn("label", F.lit(None).cast("string")), ["id"], out="sentiment")
    return fx.posts(spark, sf).select("id").join(scored, "id").select("id", "sentiment", r6("proba").alias("proba"))


def _vec_split(spark, sf):
    v = fx.vectors(spark, sf).withColumn("label", F.concat(F.lit("c"), F.col("label").cast("string")))
    v = v.withColumn("weight", F.when(F.col("vec_id") % 4 == 0, F.lit(10.0)).otherwise(F.lit(1.0)))
    split = sampling.stratified_split(v.select("vec_id", "label"), "label", "vec_id", fractions=(0.8, 0.2), names=("train", "val"))
    return v.join(split.select("vec_id", "split"), "vec_id")


def _f1_rows(pred, model_name):
    out = []
    for split in ("train", "val"):
        f = evaluate.macro_f1(pred.filter(F.col("split") == split), "label", "pred").first()["macro_f1"]
        out.append((model_name, split, float(f)))
    return out


@query("train_vector_classifier")
def train_vector_classifier(spark, sf):
    """Linear (weighted logistic regression) and hidden-layer (perceptron on a weighted
    bootstrap) classifiers on the vectors; macro F1 on train and validation."""
    v = even_parts(_vec_split(spark, sf), fx.vectors(spark, sf).count()).checkpoint()
    rows = []
    for kind in ("linear", "mlp"):
        m = classify.fit_vector_classifier(v.filter(F.col("split") == "train"), "vec", "label", kind=kind, weight="weight", hidden=256, max_iter=100, id_col="vec_id")
        rows += _f1_rows(classify.score_vectors(m, v, "vec", ["vec_id", "label", "split"]), kind)
    return spark.createDataFrame(rows, "model string, split string, macro_f1 double")


ACCOUNT_GRID = [("logistic", {"C": 1.0, "tol": 1e-4}), ("tree", {"criterion": "entropy", "min_leaf": 2}), ("svm", {"C": 1.0, "tol": 1e-4})]


@query("train_account_classifier")
def train_account_classifier(spark, sf):
    """Logistic regression, decision tree, linear SVM and 5-NN on standardised vectors
    (scaling fitted on the training rows only)."""
    v = _vec_split(spark, sf)
    train = v.filter(F.col("split") == "train")
    v = even_parts(vo.standardise(v, "vec", fit=train), fx.vectors(spark, sf).count()).checkpoint()
    train, val = v.filter(F.col("split") == "train"), v.filter(F.col("split") == "val")
    rows = []
    for name, params in ACCOUNT_GRID:
        ft, fv = classify.fold_scores(train, val, "vec", "label", name, params)
        rows.append((name, str(sorted(params.items())), float(ft), float(fv)))
    knn = vo.knn_classify(val, train, "vec_id", "vec", "label", k=5, metric="manhattan", weights="distance")
    kv = evaluate.macro_f1(knn.join(val.select("vec_id", "label"), "vec_id"), "label", "pred").first()["macro_f1"]
    rows.append(("knn", "[('k', 5), ('metric', 'manhattan'), ('weights', 'distance')]", None, float(kv)))
    return spark.createDataFrame(rows, "model string, params string, train_f1 double, val_f1 double")


CV_GRID = [
    ("logistic", {"C": 0.5, "tol": 1e-4}), ("logistic", {"C": 1.0, "tol": 1e-4}), ("tree", {"criterion": "entropy", "min_leaf": 2}),
    ("svm", {"C": 1.0, "max_iter": 10}), ("knn", {"k": 5, "metric": "manhattan", "weights": "distance"}),
]


@query("cv_grid")
def cv_grid(spark, sf):
    """10 stratified folds x four classifier families, vectors standardised inside the fold."""
    v = fx.vectors(spark, sf).withColumn("label", F.concat(F.lit("c"), F.col("label").cast("string")))
    return classify.cv_grid(v, "vec_id", "vec", ["label"], CV_GRID, scalings=("standard",), parallel=8)


# --- clustering and projection --------------------------------------------------------
def _proj(spark, sf, k):
    return cluster.pca_project(fx.vectors(spark, sf), "vec_id", "vec", k, "vec")


@query("kmeans_clusters")
def kmeans_clusters(spark, sf):
    return cluster.kmeans(fx.vectors(spark, sf), "vec_id", "vec", k=5, seed=42)


def _sql_lloyd(rounds: int) -> str:
    near = "list_distance(p.e, c.e)"
    sql = """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
c0 AS (SELECT row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42')) - 1 AS k, e FROM p QUALIFY k < 5)"""
    for i in range(rounds + 1):
        sql += f", a{i} AS (SELECT vec_id, any_value(p.e) AS e, arg_min(k, ({near}, k)) AS k, min({near}) AS d FROM p, c{i} c GROUP BY vec_id)"
        if i < rounds:
            sql += (
                f", m{i} AS (SELECT k, list(m ORDER BY j) AS e FROM (SELECT k, j, avg(e[j]) AS m FROM a{i}, "
                f"(SELECT unnest(range(1, (SELECT max(len(e)) FROM p) + 1)) AS j) GROUP BY k, j) GROUP BY k)"
                f", c{i + 1} AS (SELECT k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (k))"
            )
    return sql + f" SELECT vec_id, k AS kmeans_cluster, round(d, 6) AS distance FROM a{rounds}"


@query("kmeans_from_start", _sql_lloyd(3))
def kmeans_from_start(spark, sf):
    """Labels and distances after three rounds from five centres that md5 picks."""
    v = fx.vectors(spark, sf)
    first = v.orderBy(F.md5(F.concat(F.col("vec_id").cast("string"), F.lit(":42")))).limit(5).collect()
    found, _ = cluster.lloyd(v, "vec_id", "vec", [r["vec"] for r in first], rounds=3)
    return found.select("vec_id", "kmeans_cluster", r6("distance").alias("distance"))


@query("gmm_clusters")
def gmm_clusters(spark, sf):
    """Gaussian mixture on a 10-d PCA projection (covariance cost grows with d^2)."""
    return cluster.gmm(_proj(spark, sf, 10), "vec_id", "vec", k=5, seed=42)


@query("dbscan")
def dbscan(spark, sf):
    """DBSCAN (eps 0.05, 5 samples incl. self) on a 3-d projection."""
    return cluster.dbscan(_proj(spark, sf, 3), "vec_id", "vec", eps=0.05, min_samples=5)


_SQL_DBSCAN = """WITH RECURSIVE p AS (SELECT vec_id, round(sum(CASE WHEN i % 2 = 1 THEN CAST(embedding[i] AS DOUBLE) ELSE 0.0 END), 6) AS x,
  round(sum(CASE WHEN i % 2 = 0 THEN CAST(embedding[i] AS DOUBLE) ELSE 0.0 END), 6) AS y FROM embeddings, range(1, len(embedding) + 1) t(i) GROUP BY vec_id),
e AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM p a, p b WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.1),
core AS (SELECT src AS id FROM e GROUP BY src HAVING count(*) >= 5),
ce AS (SELECT src, dst FROM e WHERE src IN (SELECT id FROM core) AND dst IN (SELECT id FROM core)),
reach AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, ce.dst FROM reach r JOIN ce ON r.b = ce.src),
comp AS (SELECT a AS id, dense_rank() OVER (ORDER BY min(b)) - 1 AS cid FROM reach GROUP BY a),
lab AS (SELECT id, cid FROM comp UNION ALL SELECT e.src, min(comp.cid) FROM e JOIN comp ON e.dst = comp.id WHERE e.src NOT IN (SELECT id FROM core) GROUP BY e.src)
SELECT p.vec_id, COALESCE(lab.cid, -1) AS dbscan_cluster FROM p LEFT JOIN lab ON p.vec_id = lab.id"""


def _plane(spark, sf):
    """Every vector as the sums of its odd and even entries."""
    part = lambda r: F.round(F.aggregate(F.transform("vec", lambda x, i: F.when(i % 2 == r, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x), 6)
    return fx.vectors(spark, sf).select("vec_id", F.array(part(0), part(1)).alias("vec"))


@query("dbscan_plane", _SQL_DBSCAN)
def dbscan_plane(spark, sf):
    """DBSCAN (eps 0.1, 5 samples incl. self) on the plane of the sums of odd and even entries."""
    return cluster.dbscan(_plane(spark, sf), "vec_id", "vec", eps=0.1, min_samples=5)


_SQL_DBSCAN_VECTORS = _SQL_DBSCAN[: _SQL_DBSCAN.index("p AS")] + """p AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
e AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM p a, p b WHERE list_distance(a.e, b.e) <= 1.15)""" + _SQL_DBSCAN[_SQL_DBSCAN.index(",\ncore AS") :]


@query("dbscan_vectors", _SQL_DBSCAN_VECTORS)
def dbscan_vectors(spark, sf):
    """DBSCAN (eps 1.15, 5 samples incl. self) on the whole vectors, in all their dimensions."""
    return cluster.dbscan(fx.vectors(spark, sf), "vec_id", "vec", eps=1.15, min_samples=5)


_SQL_SHIFT = _SQL_DBSCAN[: _SQL_DBSCAN.index(",\ne AS")] + """,
r AS (SELECT min(vec_id) AS seed, x, y, 0 AS step, false AS still, CAST(0 AS BIGINT) AS n FROM p GROUP BY x, y
  UNION ALL SELECT r.seed, avg(p.x), avg(p.y), r.step + 1,
  sqrt((avg(p.x) - r.x) * (avg(p.x) - r.x) + (avg(p.y) - r.y) * (avg(p.y) - r.y)) <= 0.0003, count(*)
  FROM r, p WHERE NOT r.still AND r.step < 300 AND sqrt((p.x - r.x) * (p.x - r.x) + (p.y - r.y) * (p.y - r.y)) <= 0.3 GROUP BY r.seed, r.x, r.y, r.step)
SELECT seed, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, n FROM r WHERE still"""


@query("mean_shift_seeds", _SQL_SHIFT)
def mean_shift_seeds(spark, sf):
    """Where every point of the plane ends under mean shift (bandwidth 0.3), with the points
    around it."""
    ends = density.shifted_seeds(_plane(spark, sf), "vec_id", "vec", 0.3)
    return ends.select("seed", *[(F.round(F.col("v")[i], 4) + F.lit(0.0)).alias(a) for i, a in enumerate("xy")], "n")


@query("mean_shift")
def mean_shift(spark, sf):
    """Flat-kernel mean shift (bandwidth 0.1) on a 3-d projection."""
    return density.mean_shift(_proj(spark, sf, 3), "vec_id", "vec", bandwidth=0.1, seeds="bins")


@query("cluster_table")
def cluster_table(spark, sf):
    """k-means, mixture and mean-shift labels side by side, joined on the key."""
    v = fx.vectors(spark, sf)
    km = cluster.kmeans(v, "vec_id", "vec", k=5, seed=42)
    gm = cluster.gmm(_proj(spark, sf, 10), "vec_id", "vec", k=5, seed=42)
    ms = density.mean_shift(_proj(spark, sf, 3), "vec_id", "vec", bandwidth=0.1, seeds="bins")
    return v.select("vec_id", "label").join(km, "vec_id").join(gm, "vec_id").join(ms, "vec_id")


@query("project_low_dim")
def project_low_dim(spark, sf):
    """2-d, 3-d and 10-d positions on raw, standardised and L2-normalised vectors."""
    from chorus.functions import vectors as vf

    v = fx.vectors(spark, sf)
    feats = {
        "original": v,
        "scaled": vo.standardise(v, "vec"),
        "normalised": v.withColumn("vec", vf.l2_normalise("vec")),
    }
    out = None
    for name, d in feats.items():
        part = cluster.low_dim_columns(d, "vec_id", "vec").withColumn("feature", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# --- encoding, models, composition ------------------------------------------------------
@query("encode_texts")
def encode_texts(spark, sf):
    """Posts encoded to 64-d vectors (JVM hashing encoder), pooled per account by mean."""
    p = fx.posts(spark, sf).filter(F.col("username").isNotNull()).select("id", "username", tx.clean_text("tweet").alias("t"))
    e = encode.encode_texts(p, "id", "t", dim=64)
    pooled = vo.mean_vector_by_key(e.join(p.select("id", "username"), "id"), "username", "vec")
    return vo.explode_vector(pooled, ["username"], "vec").select("username", "dim", r6("value").alias("value"))


@query("model_round_trip")
def model_round_trip(spark, sf):
    """A fitted vocabulary + topic pipeline saved to the shared folder, loaded back and
    used to score; the loaded model must give the same topics."""
    model, p = _lda(spark, sf)
    path = scratch_path(spark, "model")
    model.write().save(path)
    loaded = PipelineModel.load(path)
    a = topics.post_topics(model, p, "id").withColumnRenamed("topic", "t_fit").withColumnRenamed("topic_proba", "p_fit")
    b = topics.post_topics(loaded, p, "id")
    return a.join(b, "id").select("id", "topic", r6("topic_proba").alias("topic_proba"), (F.col("topic") == F.col("t_fit")).alias("same_topic"))


# Sentiment recode of the scored posts (fine -> report labels)
SENTIMENT_RECODE = {"ambiguous": "neutral"}


@query("enriched_posts")
def enriched_posts(spark, sf):
    """clean -> join accounts -> sentiment (right join keeps scored posts without an
    account) -> recode -> topic -> join on id."""
    posts = even_parts(fx.posts(spark, sf).select("id", "username", "tweet"))
    # read by the join to accounts and by the scoring
    clean = tx.with_clean(posts, "tweet", "t").select("id", "username", "t").filter(tx.text_length("t") >= 10).checkpoint()
    with_acc = rel.join_lower_key(clean.select("id", "username"), fx.accounts(spark, sf), "username", "username")
    model, _ = _text_model(spark, sf)
    scored = classify.predict_labels(model, classify.text_features(clean, "t", 2).withColumn("label", F.lit(None).cast("string")), ["id"], out="sentiment")
    j = with_acc.join(scored, "id", "right")
    j = rel.recode(j, "sentiment", SENTIMENT_RECODE)
    lda, p = _lda(spark, sf)
    tp = topics.post_topics(lda, p, "id")
    return j.join(tp, "id").select("id", "username", "party", "coalition", "role", "sentiment", "topic", r6("topic_proba").alias("topic_proba"))
