import numpy as np
from common_llm import SF

from chorus.llm import pivots


def brute(ids, x, least=0.95):
    """Exact links and components; x may hold None."""
    ok = [k for k, v in enumerate(x) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    u = np.array([x[k] for k in ok], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= least
    np.fill_diagonal(near, False)
    parent = {i: i for i in ids}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in zip(*np.nonzero(near)):
        p, q = sorted((root(ids[ok[a]]), root(ids[ok[b]])))
        parent[q] = p
    links = {i: 0 for i in ids}
    for a, k in enumerate(ok):
        links[ids[k]] = int(near[a].sum())
    return {i: (links[i], root(i)) for i in ids}


def as_dict(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in df.collect()}


def test_against_all_pairs(spark):
    for sf in (SF, "/root/testdata/sf0.1"):
        t = spark.read.parquet(f"{sf}/embeddings.parquet")
        rows = t.select("vec_id", "embedding").collect()
        want = brute([r[0] for r in rows], [r[1] for r in rows])
        got = as_dict(pivots.near_duplicates(t))
        assert got.keys() == want.keys()
        found, real = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
        assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.98 * real


def test_recall_down_to_the_threshold(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1500):
        a = rng.normal(size=64)
        b = rng.normal(size=64)
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        c = rng.uniform(0.951, 0.99)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (c * a + np.sqrt(1 - c * c) * b).tolist())]
    got = as_dict(pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert sum(n for n, _ in got.values()) >= 0.97 * 3000


def test_large_group_and_edges(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.05).tolist()) for i in range(700)]
    rows += [(1000 + i, base.tolist()) for i in range(300)]
    rows += [(2000 + i, rng.normal(size=16).tolist()) for i in range(100)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [None] * 16), (3003, [float("nan")] * 16), (3004, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, size int")
    got, want = as_dict(pivots.near_duplicates(df)), brute([r[0] for r in rows], [r[1] for r in rows])
    assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}
    assert sum(n for n, _ in got.values()) >= 0.98 * sum(n for n, _ in want.values())
    assert all(got[i] == (0, i) for i in range(3000, 3005))
    null = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in pivots.near_duplicates(null).collect()), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
