import time

import numpy as np
import pytest
from common_llm import SF

from chorus.llm import mih


def brute(ids, x, asked, k):
    out = {}
    for i, q in asked:
        s = (x * q).sum(1)
        o = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
        out[i] = [(int(ids[j]), float(s[j])) for j in o]
    return out


@pytest.mark.parametrize("sf,every", [("/root/testdata/sf0.1", 20), (SF, 1)])
def test_recall_against_brute_force(spark, sf, every):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    t = table.toPandas()
    ids, x = t.vec_id.to_numpy(), np.stack(t.embedding.to_numpy()).astype(float)
    got = mih.search(table, table.where(f"vec_id % {every} = 0"), 20).toPandas()
    want = brute(ids, x, [(i, x[k]) for k, i in enumerate(ids) if i % every == 0], 20)
    hits = 0
    for i, part in got.sort_values("rank").groupby("query_id"):
        assert list(part["rank"]) == list(range(1, 21))
        hits += len(set(part.vec_id) & {j for j, _ in want[i]})
        assert all(abs(s - dict(zip(ids, (x * x[list(ids).index(i)]).sum(1)))[v]) < 1e-12 for v, s in zip(part.vec_id[:2], part.score[:2]))
    assert set(got.query_id) == set(want) and hits / (20 * len(want)) >= 0.9


def test_every_code_within_the_radius_is_retrieved():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 256, (400, mih.PARTS), dtype=np.uint8)
    near = code.copy()
    near[:, :3] ^= rng.integers(0, 256, (400, 3), dtype=np.uint8)
    index = mih.SubstringIndex(near)
    for r in (0, 3, 7, 31, 32, 40, 100, 128):
        assert (index.within(code, np.full(400, r)) == (mih.hamming(code, near) <= r)).all()


def test_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=8) * (1 + i % 5)], "x") for i in range(60)]
    rows += [(100, None, "x"), (101, [0.0] * 8, "x"), (102, [None] + [1.0] * 7, "x"), (103, [float("nan")] * 8, "x"), (104, [1.0] * 3, "x"),
             (105, [float("inf")] * 8, "x"), (106, [], "x")]
    rows += [(200 + i, [1.0, 2.0] * 4, "x") for i in range(30)]  # equal vectors
    rows += [(200, [1.0, 2.0] * 4, "x")]  # a row given twice
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = mih.search(df, df.where("vec_id % 20 = 0"), 20).toPandas()
    good = [(i, v) for i, v, _ in rows if i < 100 or i >= 200]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    want = brute(ids, x, [(i, np.array(v)) for i, v in good if i % 20 == 0], 20)
    for i, part in got.sort_values("rank").groupby("query_id"):
        assert len(part) == 20
        assert len({*part.vec_id} & {j for j, _ in want[i]}) >= 15
    assert set(got.query_id) == set(want)
    # the group of equal vectors: exact, ties to the smaller id
    assert list(got[got.query_id == 200].sort_values("rank").vec_id)[:5] == [j for j, _ in want[200]][:5]
    few = spark.createDataFrame(rows[:3], df.schema)
    assert mih.search(few, few, 20).count() == 6
    empty = spark.createDataFrame([], df.schema)
    assert mih.search(empty, empty, 20).count() == 0 and mih.search(df, empty, 20).count() == 0


def test_sparse_and_dense_buckets_retrieve_the_same():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (1003, mih.PARTS), dtype=np.uint8)
    near = base.copy()
    near[:, 5] ^= 1 << rng.integers(0, 8, 1003).astype(np.uint8)
    index = mih.SubstringIndex(near)
    radius = rng.integers(0, 2, 1003)
    assert 8 * np.count_nonzero(index.retrieved(base, radius)) < 1003 * 1003  # pairs are compared one by one
    assert (index.within(base, radius) == (mih.hamming(base, near) <= radius[:, None])).all()
    radius = rng.integers(0, 300, 1003)
    assert (index.within(base, radius) == (mih.hamming(base, near) <= radius[:, None])).all()


def test_copies_are_ranked_by_id():
    x = np.ones((mih.BLOCK, 4))
    ids = np.random.default_rng(4).permutation(len(x)).astype(np.int64)
    who, row, score = mih.best(x[:40], ids[:40], x, ids, np.ones((40, len(x)), bool), 20)
    for i in range(40):
        assert list(ids[row[who == i]]) == [j for j in range(21) if j != ids[i]][:20]
    assert (score == 4).all()


def test_probing_costs_less_than_a_few_passes_over_the_codes():
    rng = np.random.default_rng(5)
    code = rng.integers(0, 256, (mih.BLOCK, mih.PARTS), dtype=np.uint8)
    index, asked, radius = mih.SubstringIndex(code), code[:256].copy(), np.full(256, 112)
    index.within(asked, radius)  # the balls are made once a block

    def cpu(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    passes = min(cpu(lambda: mih.hamming(asked, code)) for _ in range(3))
    assert min(cpu(lambda: index.within(asked, radius)) for _ in range(3)) < 8 * passes
