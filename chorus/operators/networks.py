"""Small networks on vectors: distributed mini-batch training with a metrics row per epoch.

A network is linear layers with ReLU and dropout between them and a softmax at the end, trained
by Adam on the cross entropy.  Rows are dealt into parts once.  In an epoch every part starts from
the common weights, draws rows with replacement in proportion to their weight (as many as its
share of the total weight of all training rows asks for), and takes mini-batch steps; weights and
Adam moments are then averaged over the parts by rows drawn.  With one part that is the sequential
trainer, step for step.  The pass of an epoch also counts the answers of the weights that it
starts from (without dropout), so the history costs no pass of its own but one at the end.

Only weights travel: parts are combined in groups of ``FAN`` on the executors until one is left,
which the driver reads, whatever the number of rows.  Draws and dropout are seeded by (seed, epoch, part).

Defined results: rows with a null label are not trained on; null vectors are left out and get no
prediction; labels are the sorted distinct ones of the training rows, and a validation label
beyond them is never right.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chorus.session import checkpoint_dir

PART_ROWS = 8192
FAN = 16
HISTORY = "run string, epoch long, loss double, train_f1 double, val_f1 double"


@dataclass(frozen=True)
class Network:
    hidden: tuple[int, ...] = ()
    dropout: float = 0.0
    lr: float = 1e-3
    batch: int = 500
    epochs: int = 100
    seed: int = 0


# the three networks: linear, one hidden layer, and that with dropout
NETWORKS = {"linear": Network(), "hidden": Network((256,)), "dropout": Network((256,), 0.3)}


def shapes(width: int, hidden: tuple[int, ...], classes: int) -> list[tuple[int, ...]]:
    sizes = [width, *hidden, classes]
    return [s for a, b in zip(sizes, sizes[1:]) for s in ((a, b), (b,))]


def start(width: int, net: Network, classes: int) -> np.ndarray:
    """All weights as one vector, uniform within 1 / sqrt(inputs) of each layer."""
    rng = np.random.default_rng([net.seed, 0x5EED])
    out, inputs = [], width
    for s in shapes(width, net.hidden, classes):
        if len(s) == 2:
            inputs = s[0]
        out.append(rng.uniform(-1, 1, s).ravel() / np.sqrt(inputs))
    return np.concatenate(out)


def layers(theta: np.ndarray, width: int, hidden: tuple[int, ...], classes: int) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(width, hidden, classes):
        n = int(np.prod(s))
        out.append(theta[at : at + n].reshape(s))
        at += n
    return out


def probabilities(theta: np.ndarray, x: np.ndarray, net: Network, classes: int) -> np.ndarray:
    w = layers(theta, x.shape[1], net.hidden, classes)
    for i in range(0, len(w), 2):
        x = x @ w[i] + w[i + 1]
        if i + 2 < len(w):
            x = np.maximum(x, 0)
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(theta: np.ndarray, x: np.ndarray, y: np.ndarray, net: Network, classes: int, rng=None) -> tuple[float, np.ndarray]:
    """Mean cross entropy and its derivative; ``rng`` draws the dropout, without it none."""
    w = layers(theta, x.shape[1], net.hidden, classes)
    inputs, masks = [x], []
    for i in range(0, len(w) - 2, 2):
        h = inputs[-1] @ w[i] + w[i + 1]
        keep = (h > 0).astype(float)
        if net.dropout and rng is not None:
            keep *= (rng.random(h.shape) >= net.dropout) / (1 - net.dropout)
        inputs.append(h * keep)
        masks.append(keep)
    z = inputs[-1] @ w[-2] + w[-1]
    z -= z.max(axis=1, keepdims=True)
    logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    rows = np.arange(len(y))
    g = np.exp(logp)
    g[rows, y] -= 1
    g /= len(y)
    grads = []
    for i in range(len(w) - 2, -1, -2):
        grads = [(inputs[i // 2].T @ g).ravel(), g.sum(axis=0), *grads]
        if i:
            g = (g @ w[i].T) * masks[i // 2 - 1]
    return float(-logp[rows, y].mean()), np.concatenate(grads)


def adam(theta, m, v, g, t: float, lr: float):
    m = 0.9 * m + 0.1 * g
    v = 0.999 * v + 0.001 * g * g
    return theta - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), m, v


def train_part(state: np.ndarray, x, y, p, draws: int, net: Network, classes: int, seed: list[int]) -> tuple[np.ndarray, float]:
    """One epoch over ``draws`` rows drawn by ``p``; state is (weights, both moments, steps)."""
    n = (len(state) - 1) // 3
    theta, m, v, t = state[:n], state[n : 2 * n], state[2 * n : 3 * n], state[-1]
    rng = np.random.default_rng(seed)
    picks = rng.choice(len(y), draws, p=p)
    total = 0.0
    for lo in range(0, draws, net.batch):
        rows = picks[lo : lo + net.batch]
        loss, g = loss_and_gradient(theta, x[rows], y[rows], net, classes, rng)
        t += 1
        theta, m, v = adam(theta, m, v, g, t, net.lr)
        total += loss * len(rows)
    return np.concatenate([theta, m, v, [t]]), total


def macro_f1(confusion: np.ndarray) -> float:
    """Of a (truth x answer) table, over the classes that occur in either."""
    hit, truth, said = np.diag(confusion), confusion.sum(1), confusion.sum(0)
    seen = truth + said > 0
    return float((2 * hit[seen] / (truth + said)[seen]).mean()) if seen.any() else 0.0


_PART = "grp long, draws double, loss double, train binary, val binary, state binary"


def _row(grp: int, draws: float, loss: float, train: np.ndarray, val: np.ndarray, state: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array([grp], pa.int64()), pa.array([float(draws)]), pa.array([float(loss)]), *(pa.array([a.astype(float).tobytes()]) for a in (train, val, state))]
    return pa.RecordBatch.from_arrays(cols, names=["grp", "draws", "loss", "train", "val", "state"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one width as rows; the numbers are not made Python objects."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _pass(model, net: Network, classes: int, epoch: int, per_weight: float):
    """Counts the answers of the common weights, then trains on the part's training rows."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        part, state = TaskContext.get().partitionId(), model.value
        x = _matrix(t.column("x"))
        y, w, train = t.column("y").to_numpy(), t.column("weight").to_numpy(), t.column("train").to_numpy()
        theta = state[: (len(state) - 1) // 3]
        answer = probabilities(theta, x, net, classes).argmax(axis=1)
        tables = []
        for rows in (train, ~train):  # a label without a class stands in a row of its own
            c = np.zeros((classes + 1, classes + 1))
            np.add.at(c, (y[rows], answer[rows]), 1)
            tables.append(c)
        draws, loss = int(round(w[train].sum() * per_weight)), 0.0
        if draws and epoch <= net.epochs:
            p = w[train] / w[train].sum()
            state, loss = train_part(state, x[train], y[train], p, draws, net, classes, [net.seed, epoch, part])
        yield _row(part, draws, loss, *tables, state * draws)

    return run


def _add(groups: int):
    def run(batches):
        sums: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                new = [r["draws"], r["loss"], *(np.frombuffer(r[n]) for n in ("train", "val", "state"))]
                g = r["grp"] % groups
                sums[g] = [a + c for a, c in zip(sums[g], new)] if g in sums else new
        for g, s in sums.items():
            yield _row(g, *s)

    return run


def _combined(rows: DataFrame, parts: int) -> tuple[float, float, np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the parts, in the order of their numbers; one row reaches the driver."""
    while parts > 1:
        groups = -(-parts // FAN)
        to = rows.withColumn("to", F.pmod("grp", F.lit(groups))).repartition(groups, "to").sortWithinPartitions("grp")
        rows = to.drop("to").mapInArrow(_add(groups), _PART)
        parts = groups
    (r,) = rows.collect()
    return (r["draws"], r["loss"], *(np.frombuffer(r[n]) for n in ("train", "val", "state")))


@dataclass(frozen=True)
class Fitted:
    theta: np.ndarray
    labels: list
    net: Network
    history: list[tuple]


def deal(df: DataFrame, id_col: str, vec: str, label: str, split: str, weight: str | None = None, part_rows: int = PART_ROWS) -> tuple[DataFrame, list, int, int]:
    """Rows for ``fit``: (part's rows, labels, parts, width); checkpointed, so that parts stay
    as they are."""
    checkpoint_dir(df.sparkSession)
    df = df.where(F.col(vec).isNotNull() & F.col(label).isNotNull())
    train = F.coalesce(F.col(split) == "train", F.lit(False))
    labels = [r["l"] for r in df.where(train).select(F.col(label).alias("l")).distinct().orderBy("l").collect()]
    if not labels:
        raise ValueError("no training row with a vector and a label")
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label))
    y = F.when(place > 0, place - 1).otherwise(len(labels)).cast("int")
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0), F.lit(0.0)).cast("double")
    key = F.xxhash64(F.col(id_col).cast("string"))
    rows = df.select(key.alias("key"), F.col(vec).cast("array<double>").alias("x"), y.alias("y"), w.alias("weight"), train.alias("train"))
    parts = max(1, -(-df.count() // part_rows))
    rows = rows.repartition(parts, F.pmod("key", F.lit(parts))).sortWithinPartitions("key", "x").drop("key").checkpoint()
    return rows, labels, parts, len(rows.select("x").first()["x"])


def fit(dealt: tuple[DataFrame, list, int, int], net: Network) -> Fitted:
    """The weights after all epochs, and (epoch, loss, train_f1, val_f1) of each."""
    rows, labels, parts, width = dealt
    sc = rows.sparkSession.sparkContext
    n, total = rows.where("train").agg(F.count(F.lit(1)), F.sum("weight")).first()
    theta = start(width, net, len(labels))
    state = np.concatenate([theta, np.zeros(2 * len(theta) + 1)])
    history, loss = [], 0.0
    for epoch in range(1, net.epochs + 2):
        model = sc.broadcast(state)  # the weights of the network, whatever the number of rows
        sums = _combined(rows.mapInArrow(_pass(model, net, len(labels), epoch, n / total if total else 0.0), _PART), parts)
        model.destroy()
        side = len(labels) + 1
        if epoch > 1:
            history.append((epoch - 1, loss, *(macro_f1(sums[i].reshape(side, side)) for i in (2, 3))))
        if epoch <= net.epochs and sums[0]:
            state, loss = sums[4] / sums[0], sums[1] / sums[0]
    return Fitted(state[: len(theta)], labels, net, history)


def histories(dealt: tuple[DataFrame, list, int, int], nets: dict[str, Network]) -> DataFrame:
    """(run, epoch, loss, train_f1, val_f1): one row per network and epoch."""
    rows = [(name, *r) for name, net in nets.items() for r in fit(dealt, net).history]
    return dealt[0].sparkSession.createDataFrame(rows, HISTORY)


def predict(model: Fitted, df: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, pred, proba) of every row with a vector."""
    src = df.where(F.col(vec).isNotNull()).select(F.col(id_col), F.col(vec).cast("array<double>").alias("_x"))

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                p = probabilities(model.theta, x, model.net, len(model.labels))
                pred = pa.array([str(model.labels[i]) for i in p.argmax(axis=1)])
                yield pa.RecordBatch.from_arrays([b.column(0), pred, pa.array(p.max(axis=1))], names=[id_col, "pred", "proba"])

    return src.mapInArrow(run, f"`{id_col}` {dict(src.dtypes)[id_col]}, pred string, proba double")
