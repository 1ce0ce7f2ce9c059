import hashlib

import numpy as np
import pytest

from chorus.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, code string, l string"


def rows(spark, vectors, labels=None, ids=None):
    n = len(vectors)
    ids = ids or list(range(n))
    labels = labels or [i % 3 for i in range(n)]
    return spark.createDataFrame([(i, v, x, "a", "b", "c", "d") for i, v, x in zip(ids, vectors, labels)], SCHEMA)


def brute(vectors: dict[int, np.ndarray], rounds=2, parts=16, entries=64):
    """Full search, in order of id."""
    ids = sorted(vectors)
    x = np.stack([np.floor(256 * np.asarray(vectors[i], np.float64)).astype(np.int64) for i in ids]).reshape(len(ids), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]

    def assign():
        d = np.stack([((x[:, p, None] - books[p][None]) ** 2).sum(-1) for p in range(parts)], 1)
        return d.argmin(-1), d.min(-1)

    for _ in range(rounds):
        a, _ = assign()
        for p in range(parts):
            for e in set(a[:, p]):
                m = x[a[:, p] == e, p]
                books[p][e] = m.sum(0) // len(m)
    a, d = assign()
    digest = hashlib.sha256(",".join(map(str, np.concatenate([b.ravel() for b in books]))).encode()).hexdigest()
    return {i: ("".join(f"{c:02x}" for c in r), int(s)) for i, r, s in zip(ids, a, d.sum(1))}, digest


def test_search_is_exact_with_ties_and_skips_entries():
    rng = np.random.default_rng(5)
    for dim in (1, 2, 4, 7):
        book = rng.integers(-40, 40, (64, dim))
        book[10:20] = book[30:40]  # equal entries: the lower index is taken
        x = rng.integers(-60, 60, (3000, dim))
        code, best, computed = codes.EqualAverage.of(book).nearest(x)
        d = ((x[:, None] - book[None]) ** 2).sum(-1)
        assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
        assert computed < d.size * (0.3 if dim == 1 else 0.95)


def test_equal_to_full_search(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 32)).astype("f4")
    v[100:140] = v[5]  # repeated vectors
    labels = [None if i % 5 == 0 else 7 if i % 3 else i for i in range(400)]
    out = {r["vec_id"]: r for r in codes.compress(rows(spark, v.tolist(), labels).repartition(7)).collect()}
    want, digest = brute(dict(enumerate(v)))
    assert {i: (r["code"], r["error"]) for i, r in out.items()} == want
    assert {r["codebooks_sha256"] for r in out.values()} == {digest}
    for i, r in out.items():
        assert r["label_error"] == sum(want[j][1] for j in want if labels[j] == labels[i])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    base = [0.5] * 16
    vectors = [base, None, [None, *base[1:]], [nan, *base[1:]], [inf, *base[1:]], [], base, [-1.0] * 16, [3e38] * 16, base[:8]]
    table = rows(spark, vectors, [None, 1, 1, 1, 1, 1, 2, 2, 9, 1], [4, 0, 1, 2, 3, 5, 4, None, 7, 8])
    out = codes.compress(table).collect()
    assert sorted(str(r["vec_id"]) for r in out) == ["4", "4", "7", "None"]
    assert all(r["error"] == 0 and r["label_error"] == 0 and len(r["code"]) == 32 for r in out)
    assert codes.compress(rows(spark, [], [], [])).count() == 0
    assert codes.compress(rows(spark, [None, [nan]])).count() == 0
    with pytest.raises(ValueError):
        codes.compress(rows(spark, [[1.0] * 17]))


def test_decode(spark):
    v = np.random.default_rng(2).normal(size=(64, 16)).astype("f4")
    table = rows(spark, v.tolist())
    books = codes.train(table, rounds=0)
    for r in codes.encode(table, books).collect():  # every vector is an entry of each part
        assert np.abs(books.decode(r["code"]) - v[r["id"]]).max() <= 1 / 256


def test_a_label_with_most_rows_is_joined_between_two_exchanges(spark):
    v = np.random.default_rng(3).normal(size=(300, 16)).astype("f4")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = codes.compress(rows(spark, v.tolist(), [1] * 300))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 2 and "Aggregate" not in plan
