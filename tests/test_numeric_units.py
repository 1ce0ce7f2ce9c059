"""Hand-computed answers for the numeric traps (quartiles, scaling, macro F1, kappa,
histograms, vector helpers)."""

import math

import pytest
from pyspark.sql import functions as F

from chorus.functions import vectors as vf
from chorus.operators import agreement, aggregate, evaluate
from chorus.operators import vectors as vo


def test_describe_quartiles_interpolate_like_pandas(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "x long")
    r = aggregate.describe(df, "x").first()
    assert (r["count"], r["min"], r["max"]) == (4, 1.0, 10.0)
    assert r["q25"] == pytest.approx(1.75) and r["q50"] == pytest.approx(2.5) and r["q75"] == pytest.approx(4.75)
    assert r["std"] == pytest.approx(4.0824829, rel=1e-6)  # n - 1


def test_standardise_uses_population_std_and_constant_dims(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id long, v array<double>")
    got = {r["id"]: r["v"] for r in vo.standardise(df, "v").collect()}
    assert got == {1: [-1.0, 0.0], 2: [1.0, 0.0]}
    mm = {r["id"]: r["v"] for r in vo.minmax_scale(df, "v").collect()}
    assert mm == {1: [0.0, 0.0], 2: [1.0, 0.0]}  # a constant dimension maps to 0


def test_macro_f1_is_unweighted_over_union_of_labels(spark):
    rows = [("a", "a"), ("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "t string, p string")
    got = evaluate.macro_f1(df, "t", "p").first()
    # per class F1: a = 2*2/(4+1+1) = 2/3, b = 2/(2+1) = 2/3, c = 0
    assert got["n_labels"] == 3 and got["macro_f1"] == pytest.approx(4 / 9)
    rep = {r["row"]: r for r in evaluate.classification_report(df, "t", "p").collect()}
    assert rep["accuracy"]["f1"] == pytest.approx(3 / 5) and rep["accuracy"]["precision"] is None
    assert rep["weighted avg"]["f1"] == pytest.approx((3 * 2 / 3 + 1 * 2 / 3 + 0) / 5)


def test_confusion_matrix_zero_filled_over_fixed_labels(spark):
    df = spark.createDataFrame([("x", "y"), ("x", "x"), ("z", "q")], "t string, p string")
    got = {r["truth"]: (r["x"], r["y"], r["z"]) for r in evaluate.confusion_matrix(df, "t", "p", ["x", "y", "z"]).collect()}
    assert got == {"x": (1, 1, 0), "y": (0, 0, 0), "z": (0, 0, 0)}


def test_kappa_pairs_and_missing_as_nan(spark):
    rows = [(1, "pos", "pos", None), (2, "neg", "pos", "neg"), (3, "neg", "neg", "neg"), (4, "pos", "pos", "pos")]
    df = spark.createDataFrame(rows, "item long, a string, b string, c string")
    got = {(r["coder_a"], r["coder_b"]): r for r in agreement.kappa_pairwise(df, ["a", "b", "c"]).collect()}
    ab = got[("a", "b")]
    # Ao = 3/4; Ae = (2/4 * 3/4) + (2/4 * 1/4) = 0.5 -> kappa 0.5
    assert ab["ao"] == pytest.approx(0.75) and ab["ae"] == pytest.approx(0.5) and ab["kappa"] == pytest.approx(0.5)
    ac = got[("a", "c")]
    # c has 'nan' for item 1: Ao = 3/4, Ae = pos 2/4*1/4 + neg 2/4*2/4 = 0.375
    assert ac["ae"] == pytest.approx(0.375) and ac["kappa"] == pytest.approx((0.75 - 0.375) / 0.625)
    mean = agreement.kappa_mean(df, ["a", "b", "c"]).first()
    assert mean["pairs"] == 3 and mean["kappa"] == pytest.approx(sum(r["kappa"] for r in got.values()) / 3)


def test_histograms(spark):
    df = spark.createDataFrame([(x,) for x in [0.0, 1.0, 2.0, 9.99, 10.0]], "x double")
    fb = {r["bin"]: r["n"] for r in aggregate.hist_fixed_bins(df, "x", 10).collect()}
    assert fb == {0: 1, 1: 1, 2: 1, 9: 2}  # the right edge falls into the last bin
    fw = {r["bin"]: (r["lo"], r["n"]) for r in aggregate.hist_fixed_width(df, "x", 5.0).collect()}
    assert fw == {0: (0.0, 3), 1: (5.0, 1), 2: (10.0, 1)}


def test_vector_helpers(spark):
    df = spark.createDataFrame([([0.1, 0.7, 0.7, 0.2], [3.0, 4.0, 0.0, 0.0], "[1.5  2\n -3]")], "p array<double>, v array<double>, s string")
    r = df.select(
        vf.argmax("p").alias("am"),
        vf.l2_normalise("v").alias("l2"),
        vf.l2_normalise(F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
        vf.euclidean("v", F.array(*[F.lit(0.0)] * 4)).alias("e"),
        vf.manhattan("v", "p").alias("m"),
        vf.chebyshev("v", "p").alias("c"),
        vf.parse_vector_text("s", width=3).alias("parsed"),
    ).first()
    assert r["am"] == 1  # first maximum, 0-based
    assert r["l2"] == pytest.approx([0.6, 0.8, 0.0, 0.0]) and r["zero"] == [0.0, 0.0]
    assert r["e"] == pytest.approx(5.0) and r["m"] == pytest.approx(2.9 + 3.3 + 0.7 + 0.2) and r["c"] == pytest.approx(3.3)
    assert r["parsed"] == [1.5, 2.0, -3.0]


def test_unknown_vector_aggregate_raises(spark):
    df = spark.createDataFrame([(1, [1.0])], "k long, v array<double>")
    with pytest.raises(ValueError):
        vo.mean_vector_by_key(df, "k", "v", agg="median")
    assert vo.mean_vector_by_key(df, "k", "v").first()["vec"] == [1.0]


def test_one_hot_and_inverse(spark):
    df = spark.createDataFrame([("b",), ("z",)], "t string")
    classes = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    got = [tuple(r) for r in df.select(vf.one_hot("t", classes).alias("o"), vf.inverse_one_hot(vf.one_hot("t", classes), classes).alias("i")).collect()]
    assert got[0] == ([0, 1, 0], "b")
    assert got[1][0] == [0, 0, 0]  # unknown label: all zeros
    assert not math.isnan(0.0)


def test_deltas_and_their_sum(spark):
    from chorus.operators import series

    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.7), (1, 3, 0.4), (2, 1, 1.0)], "run long, epoch long, v double")
    d = {(r["run"], r["epoch"]): r["delta"] for r in series.series_delta(df, "run", "epoch", "v").collect()}
    assert d.keys() == {(1, 2), (1, 3)} and d[(1, 2)] == pytest.approx(0.2) and d[(1, 3)] == pytest.approx(-0.3)
    s = {r["run"]: r["delta_sum"] for r in series.delta_sum(df, "run", "epoch", "v").collect()}
    assert s[1] == pytest.approx(-0.1) and s[2] == 0.0


def test_exact_quantiles_match_percentile_with_hot_key(spark):
    rows = [("hot" if i % 3 else "k%d" % (i % 5), float((i * 7919) % 1013) / 7.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in aggregate.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.93}).collect()}
    ref = df.groupBy("k").agg(*[F.percentile("v", q).alias(n) for n, q in (("a", 0.1), ("b", 0.5), ("c", 0.93))]).collect()
    for r in ref:
        for n in "abc":
            assert got[r["k"]][n] == pytest.approx(r[n], rel=1e-12, abs=1e-12)
