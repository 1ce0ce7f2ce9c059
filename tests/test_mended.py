"""Inputs that once gave wrong answers, and the bounds that must not come back."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from chorus.functions import text as tx
from chorus.functions import vectors as vf
from chorus.operators import aggregate, classify, cluster, graph, sampling, series, topics
from chorus.operators import vectors as vo
from chorus.session import scratch_path
from chorus.sources import files
from conftest import SF_SMALL


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(299)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(300)}, 1000: 1000, 1001: 1000}


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(0)
    for n, m in ((60, 40), (200, 150), (50, 400)):
        pairs = [tuple(int(v) for v in rng.integers(0, n, 2)) for _ in range(m)]
        label = {x: x for p in pairs for x in p if p[0] != p[1]}
        changed = True
        while changed:
            changed = False
            for a, b in pairs:
                if a != b and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
        got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
        assert got == label


def test_dbscan_of_a_long_line_and_a_dense_cell(spark):
    rows = [(i, [i * 0.9, 0.0]) for i in range(300)]
    rows += [(1000 + i, [5000.0 + (i % 7) * 1e-4, 7.0]) for i in range(3000)]
    rows += [(9000, [-50.0, 3.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r["id"]: r["dbscan_cluster"] for r in cluster.dbscan(df, "id", "v", eps=1.0, min_samples=3).collect()}
    assert {got[i] for i in range(300)} == {0} and {got[1000 + i] for i in range(3000)} == {1} and got[9000] == -1


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev"])
def test_dbscan_in_three_dimensions(spark, metric):
    from test_invariants import _dbscan_ref

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.2, (60, 3)), rng.normal(1.5, 0.3, (60, 3)), rng.uniform(-2, 3, (40, 3))])
    got = {r["id"]: r["dbscan_cluster"] for r in cluster.dbscan(
        spark.createDataFrame([(i, [float(c) for c in p]) for i, p in enumerate(x)], "id long, v array<double>"), "id", "v", 0.35, 5, metric).collect()}
    if metric == "euclidean":
        assert [got[i] for i in range(len(x))] == list(_dbscan_ref(x, 0.35, 5))
    d = vo._dist_matrix(x, x, metric)
    core = (d <= 0.35).sum(1) >= 5
    assert all((got[i] >= 0) == bool(core[d[i] <= 0.35].any()) for i in range(len(x)))


def test_early_stop_on_nan_and_without_patience(spark):
    nan = float("nan")
    for md in (0.0, 1e-9):
        for values, want in (
            ([0.5, 0.7, nan, 0.9], (3, 2, 0.7, 3)),
            ([nan, 0.7], (1, None, None, 1)),
            ([0.9, 0.1, 0.1, 0.1], (3, 1, 0.9, 3)),
        ):
            df = spark.createDataFrame([(1, i + 1, v) for i, v in enumerate(values)], "run long, epoch long, v double")
            r = series.early_stop(df, "run", "epoch", "v", patience=2, min_delta=md).first()
            assert (r["stop_epoch"], r["best_epoch"], r["best_value"], r["epochs"]) == want
        df = spark.createDataFrame([(1, i + 1, 1.0 - i) for i in range(30)], "run long, epoch long, v double")
        assert series.early_stop(df, "run", "epoch", "v", patience=0, min_delta=md).first()["stop_epoch"] is None
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, nan), (1, 3, 0.1)], "run long, epoch long, v double")
    assert series.early_stop(df, "run", "epoch", "v", mode="min").first()["best_epoch"] == 1


def test_jsonc_comments_outside_strings_only(spark):
    path = scratch_path(spark, "jsonc")
    spark.createDataFrame([('// head\n["a", "http://x.y", // tail "q"\n "b\\"//c"]\n//end',)], "value string").coalesce(1).write.text(path)
    assert [r["word"] for r in files.read_jsonc_list(spark, path).orderBy("pos").collect()] == ["a", "http://x.y", 'b"//c']
    bad = scratch_path(spark, "jsonc")
    spark.createDataFrame([("[1, ",)], "value string").coalesce(1).write.text(bad)
    with pytest.raises(Exception, match="not a JSON list"):
        files.read_jsonc_list(spark, bad).collect()


def test_vector_text_with_a_leading_line_break(spark):
    df = spark.createDataFrame([("[\n 0.1 0.2]",), ("[ 1 2 \n]",)], "t string")
    assert [r[0] for r in df.select(vf.parse_vector_text("t", 2)).collect()] == [[0.1, 0.2], [1.0, 2.0]]


def test_two_labels_train_two_classes(spark):
    rows = [(i, "a" if i % 2 else "b", [float(i % 2), float(i % 3)], ["x" if i % 2 else "y"]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label string, v array<double>, grams array<string>")
    m = classify.fit_text_classifier(df, "grams", "label")
    assert m.stages[-1].numClasses == 2
    scored = classify.predict_labels(m, df.drop("label"), ["id"])
    assert {r["pred"] for r in scored.collect()} == {"a", "b"}
    val = spark.createDataFrame([(1, "new", [0.0, 0.0], ["x"])], df.schema)
    assert classify.fold_scores(df, val, "v", "label", "logistic", {})[1] == 0.0


def test_dense_term_table(spark):
    rows = E.queries()["term_counts_by_dim"](spark, SF_SMALL).collect()
    keys, terms = {(r["dim"], r["key"]) for r in rows}, {r["term"] for r in rows}
    assert len(rows) == len(keys) * len(terms) and any(r["n"] == 0 for r in rows)


def test_full_batch_topic_model(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "c"],), (["b", "c"],)], "tokens array<string>")
    lda = topics.fit_lda(df, k=2, max_iter=3, max_df=1.0).stages[-1]
    assert lda.getSubsamplingRate() == 1.0 and lda.getMaxIter() == 3


def test_table_sink_index_is_dense(spark):
    rows = [(r["index"], r["id"]) for r in E.queries()["table_sink"](spark, SF_SMALL).collect()]
    assert sorted(i for i, _ in rows) == list(range(len(rows))) and sorted(rows) == sorted(rows, key=lambda r: r[1])


def test_every_draw_falls_into_one_interval(spark):
    df = spark.createDataFrame([(i, 0.1 * (1 + i % 3)) for i in range(997)], "id long, w double")
    got = sampling.weighted_bootstrap(df, "id", "w", n=5000).collect()
    assert len(got) == 5000 == len({r["draw"] for r in got})


def test_quantiles_with_one_value_in_most_rows(spark):
    x = [5.0] * 700 + [float(i) for i in range(100)]
    df = spark.createDataFrame([("k", v) for v in x], "k string, v double")
    r = aggregate.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.999}).first()
    assert all(abs(r[n] - np.quantile(x, q)) < 1e-9 for n, q in {"a": 0.1, "b": 0.5, "c": 0.999}.items())
    d = aggregate.describe(df, "v").first()
    assert d["q75"] == np.quantile(x, 0.75) and d["count"] == 800


def test_distances_of_wide_vectors_stay_in_bounds():
    import tracemalloc

    a = np.random.default_rng(0).normal(size=(600, 768))
    tracemalloc.start()
    d = vo._dist_matrix(a, a, "manhattan")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 256 << 20 and abs(d[3, 7] - np.abs(a[3] - a[7]).sum()) < 1e-9


def test_clean_is_evaluated_once(spark):
    plan = E.queries()["filter_range"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("http") == 2  # the rule once, and the link that the fixture appends


def test_emoji_rows_without_candidates_and_all_keys_shared(spark):
    df = spark.createDataFrame([("plain",), ("x 😀",), ("ab",)], "t string")
    assert [r[0] for r in df.select(tx.emoji_to_text("t", [("😀", "smile"), ("ab", "😀")])).collect()] == ["plain", "x <smile>", "<😀>"]
    assert not math.isnan(1.0) and F is not None


def test_neighbour_slices_equal_a_full_sort():
    """Ties go to the smaller id across slices, self pairs and missing distances are left out."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (300, 3)).astype(float)
    x[7] = np.nan
    ids = np.arange(300) * 2
    for metric, slices, own in (("manhattan", 32, True), ("euclidean", 300, False), ("chebyshev", 7, True)):
        rows, dist, at = vo._nearest(x, ids, x, ids, 5, metric, slices, own)
        diff = np.abs(x[:, None] - x[None])
        d = {"manhattan": diff.sum(2), "euclidean": np.sqrt((diff**2).sum(2)), "chebyshev": diff.max(2)}[metric]
        if own:
            np.fill_diagonal(d, np.inf)
        want = [(i, j) for i in range(300) for j in np.argsort(d[i], kind="stable")[:5].tolist() if np.isfinite(d[i, j])]
        assert list(zip(rows.tolist(), at.tolist())) == want and np.allclose(dist, [d[i, j] for i, j in want])


def test_blocks_do_not_multiply_with_the_rows(spark):
    """A row is sent to as many tasks as there are blocks: few for the cores, then large ones."""
    assert vo._spread_blocks(600_000, 2048, 24) == 37 and vo._spread_blocks(10_000, 2048, 24) == 24 and vo._spread_blocks(100, 2048, 24) == 1


def test_products_decide_as_the_distances_do():
    """On grids, where distances lie exactly on a limit, and with odd values."""
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 9, (400, 3)) * 0.25, rng.integers(0, 9, (400, 3)) * 0.05 + 1e3, rng.normal(size=(300, 64))):
        x = x.copy()
        d = vo._dist_matrix(x, x, "euclidean")
        for limit in (0.05, 0.25, 0.75, 10.0):
            assert (vo.within(x, x, "euclidean", limit) == (d <= limit)).all()
            assert (vo.bins_of(x, x, "euclidean", limit) == np.floor(d / limit)).all()
    x[3, 0], x[4, 1] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        assert (vo.within(x, x, "euclidean", 9.0) == (vo._dist_matrix(x, x, "euclidean") <= 9.0)).all()


def test_word_vectors_travel_only_with_rare_words(spark, monkeypatch):
    """Frequent words are summed where the text is read, rare ones are joined; repeated ids,
    null texts and unknown words give what one mean over all occurrences gives."""
    import numpy as np

    from chorus.operators import vectors as vo

    rng = np.random.default_rng(1)
    words = [f"w{i:02d}" for i in range(30)]
    rows = [(i % 70, " ".join(rng.choice([*words, "zz"], rng.integers(0, 25)))) for i in range(90)] + [(500, None), (501, "zz zz")]
    vecs = {w: rng.normal(size=4) for w in words}
    d = spark.createDataFrame(rows, "id long, t string")
    wv = spark.createDataFrame([(w, v.tolist()) for w, v in vecs.items()], "term string, vec array<double>")
    want = {}
    for i, t in rows:
        want.setdefault(i, []).extend(vecs[w] for w in (t or "").split() if w in vecs)
    want = {i: np.mean(v, axis=0) for i, v in want.items() if v}
    for often in (5, 30, 1000):
        monkeypatch.setattr(vo, "OFTEN", often)
        found = vo.mean_word_vectors(d, "id", "t", wv)
        got = {r["id"]: r["vec"] for r in found.collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[i], want[i]) for i in want)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert ("Join" in plan) == (often <= 30)


def test_no_row_per_token_in_the_lemma_rebuild(spark, monkeypatch):
    """Texts are rebuilt where they are read; forms beyond the frequent ones are joined, repeated
    ids merge as before, and a frequent form is no join key."""
    import numpy as np

    from chorus.operators import corpus

    rng = np.random.default_rng(2)
    words = [f"W{i:02d}" for i in range(25)]
    marks = [" ", " ", "\n", ". ", "!\n", ", ", "? ", "", "\t"]
    texts = ["".join(w + m for w, m in zip(rng.choice(words, n), rng.choice(marks, n))) for n in rng.integers(0, 30, 60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "W01 again.\nW02"), (None, "W03"), (None, "W04 x"), (99, None), (98, "")]
    d = spark.createDataFrame(rows, "id long, t string")
    dic = [(w.lower(), f"l{w}" if i % 5 else None, ["subst", "fin", None, "ger"][i % 4]) for i, w in enumerate(words[:20])]
    dic = spark.createDataFrame([*dic, ("w01", "second", "ger")], "form string, lemma string, pos string")
    for tagset, interp in (("full", True), ("noun", False), ("noun", True)):
        t = d.selectExpr("id AS _id", "t AS _text")
        slow = corpus._rebuilt_by_token(t, dic, tagset, interp).collect()
        want = sorted((str(r["_id"]), (r["_out"] or "") if r["_id"] is not None else "") for r in slow)
        for often in (4, 10_000):
            monkeypatch.setattr(corpus, "OFTEN", often)
            found = corpus.lemmatize_by_dictionary(d, "id", "t", dic, tagset, interp)
            assert sorted((str(r["id"]), r["lemmatized"]) for r in found.collect()) == want
        plan = corpus._rebuilt(t.where("_id > 7"), dic.where("lemma IS NULL OR lemma <> 'second'"), tagset, interp)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan


def test_the_activity_filter_leaves_rows_in_place(spark, monkeypatch):
    """Rows are not dealt by a hot key for a short list of dropped ones; a long list is joined."""
    from chorus.operators import relational as rel

    rows = [(i, "hot" if i < 80 else f"k{i // 3}") for i in range(100)] + [(200, None), (None, "k33")]
    d = spark.createDataFrame(rows, "id long, key string").repartition(5)
    names = [k for _, k in rows]
    count = {k: sum(i is not None for i, x in rows if x == k) for k in set(names)}
    want = sorted(map(str, [r for r in rows if r[1] is None or count[r[1]] >= 3]))
    for few in (100_000, 1):
        monkeypatch.setattr(rel, "FEW_KEYS", few)
        out = rel.min_activity(d, "key", "id", 3)
        assert sorted(str((r["id"], r["key"])) for r in out.collect()) == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("broadcast" in plan) == (few > 1)
