"""Network training: gradients, the sequential trainer, many parts, histories."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chorus.operators import networks as nw
from chorus.operators import series


def points(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    y = np.where(np.abs(x[:, 0]) + np.abs(x[:, 1]) > 1.4, "far", np.where(x[:, 2] > 0, "up", "down"))
    rows = [(i, x[i].tolist(), str(y[i]), "val" if i % 5 == 0 else "train", float(1 + i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, vec array<double>, label string, split string, weight double")


@pytest.mark.parametrize("net", [nw.Network(), nw.Network((7,)), nw.Network((6, 4), 0.3)])
def test_gradient_by_finite_differences(net):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 5)), rng.integers(0, 3, 20)
    theta = nw.start(5, net, 3)
    loss, g = nw.loss_and_gradient(theta, x, y, net, 3, np.random.default_rng(9))
    for i in rng.choice(len(theta), 18, replace=False):
        d = np.zeros_like(theta)
        d[i] = 1e-6
        up, down = (nw.loss_and_gradient(theta + s * d, x, y, net, 3, np.random.default_rng(9))[0] for s in (1, -1))
        assert np.isclose(g[i], (up - down) / 2e-6, atol=1e-6)
    if not net.dropout:
        p = nw.probabilities(theta, x, net, 3)
        assert np.isclose(loss, -np.log(p[np.arange(20), y]).mean())


def test_dropout_keeps_the_expectation():
    net = nw.Network((2000,), 0.3)
    x = np.ones((1, 5))
    theta = np.abs(nw.start(5, net, 2))
    plain = nw.loss_and_gradient(theta, x, np.array([0]), net, 2)[0]
    rng = np.random.default_rng(0)
    assert np.isclose(np.mean([nw.loss_and_gradient(theta, x, np.array([0]), net, 2, rng)[0] for _ in range(100)]), plain, rtol=0.2)


@pytest.mark.parametrize("net", [nw.Network((8,), 0.3, lr=0.01, batch=50, epochs=4, seed=2), nw.Network(lr=0.05, batch=64, epochs=3)])
def test_one_part_is_the_sequential_trainer(spark, net):
    df = points(spark)
    rows = df.withColumn("key", F.xxhash64(F.col("id").cast("string"))).orderBy("key").collect()
    labels = sorted({r["label"] for r in rows if r["split"] == "train"})
    x, y = np.array([r["vec"] for r in rows]), np.array([labels.index(r["label"]) for r in rows])
    train, w = np.array([r["split"] == "train" for r in rows]), np.array([r["weight"] for r in rows])
    theta = nw.start(5, net, 3)
    m, v, t, want = 0 * theta, 0 * theta, 0, []
    for epoch in range(1, net.epochs + 1):
        rng = np.random.default_rng([net.seed, epoch, 0])
        picks = rng.choice(train.sum(), train.sum(), p=w[train] / w[train].sum())
        losses = []
        for lo in range(0, len(picks), net.batch):
            r = np.flatnonzero(train)[picks[lo : lo + net.batch]]
            loss, g = nw.loss_and_gradient(theta, x[r], y[r], net, 3, rng)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
            theta = theta - net.lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            losses += [loss] * len(r)
        said = nw.probabilities(theta, x, net, 3).argmax(1)
        f1 = [np.mean([2 * (s & (y == c) & (said == c)).sum() / ((s & (y == c)).sum() + (s & (said == c)).sum()) for c in range(3)]) for s in (train, ~train)]
        want.append((epoch, np.mean(losses), *f1))
    got = nw.fit(nw.deal(df.repartition(3), "id", "vec", "label", "split", "weight"), net)
    assert got.labels == labels and np.allclose(got.theta, theta, atol=1e-10)
    assert np.allclose(got.history, want, atol=1e-10)


def test_many_parts_learn_and_feed_early_stopping(spark):
    df = points(spark, 900)
    odd = [(10_000, None, "up", "train", 1.0), (10_001, [0.0] * 5, None, "train", 1.0), (10_002, [0.0] * 5, "unseen", "val", 1.0)]
    dealt = nw.deal(df.unionByName(spark.createDataFrame(odd, df.schema)), "id", "vec", "label", "split", "weight", part_rows=40)
    assert dealt[2] > nw.FAN
    nets = {k: nw.Network(n.hidden and (32,), n.dropout, lr=0.05, batch=20, epochs=12) for k, n in nw.NETWORKS.items()}
    h = nw.histories(dealt, nets)
    last = {r["run"]: r for r in h.where("epoch = 12").collect()}
    assert h.count() == 36 and last["hidden"]["train_f1"] > 0.8 > last["linear"]["train_f1"] and last["dropout"]["train_f1"] > 0.7
    stop = series.early_stop(h, "run", "epoch", "val_f1", patience=3)
    for r in stop.collect():
        f = [x["val_f1"] for x in h.where(F.col("run") == r["run"]).orderBy("epoch").collect()]
        best, bad, stopped = f[0], 0, None
        for e, x in enumerate(f[1:], 2):
            best, bad = (x, 0) if x > best else (best, bad + 1)
            if bad >= 3 and stopped is None:
                stopped = e
                break
        assert r["stop_epoch"] == stopped and r["best_value"] == best
    model = nw.fit(dealt, nets["hidden"])
    pred = nw.predict(model, df, "id", "vec").join(df, "id")
    assert pred.where("pred = label").count() > 0.8 * 900


def test_the_driver_reads_one_row_an_epoch(spark, monkeypatch):
    """Parts are added on the executors, in their order, until one row is left."""
    states = [np.random.default_rng(i).normal(size=5) for i in range(40)]
    data = [(i, 1.0 + i, 0.5, *(s.tobytes() for s in (states[i][:2], states[i][:2], states[i]))) for i in range(40)]
    frame = type(spark.range(1))
    sizes, collect = [], frame.collect

    def counted(self):
        got = collect(self)
        sizes.append(len(got))
        return got

    monkeypatch.setattr(frame, "collect", counted)
    for parts in (1, 7, 40):
        rows = spark.createDataFrame(data[:parts], nw._PART).repartition(3)
        draws, loss, train, val, state = nw._combined(rows, parts)
        assert draws == sum(range(1, parts + 1)) and loss == 0.5 * parts
        assert np.allclose(state, np.sum(states[:parts], axis=0)) and np.allclose(train, val)
    assert sizes == [1, 1, 1]
