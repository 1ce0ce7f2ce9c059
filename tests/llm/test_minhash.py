import re
from collections import Counter, defaultdict

import numpy as np
from common_llm import ROWS, SF, edge_docs, empty_docs

from chorus.llm import minhash


def shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[k : k + 5]) for k in range(len(words) - 4)])


def brute(rows):
    """Component of each id by exact similarity of all pairs that share a shingle."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    where = defaultdict(list)
    parent = {i: i for i, _ in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for k, (i, s) in enumerate(sets):
        hits = Counter(j for x in s for j in where[x])
        for j, n in hits.items():
            if 100 * n >= 85 * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(i), root(sets[j][0])))
                parent[b] = a
        for x in s:
            where[x].append(k)
    return {i: root(i) for i, _ in sets}


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    got = minhash.near_duplicates(docs).collect()
    assert {r["id"]: r["component_id"] for r in got} == want
    assert {r["id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert all(r["kept"] == (r["id"] == r["component_id"]) for r in got)
    assert sum(not r["kept"] for r in got) > 10


def test_large_group_of_near_copies(spark):
    """A chain through a group that spans several blocks: links, not one centre, join it."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        words = list(words)
        words[int(rng.integers(300))] = f"n{i}"  # one word changes from each to the next
        rows.append((i, " ".join(words)))
    got = {r["id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_edges(spark):
    got = minhash.near_duplicates(edge_docs(spark)).collect()
    assert len(got) == len(ROWS)
    want = brute([(i, t) for i, t, _ in ROWS])
    for r in got:
        if r["id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["id"]]
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_signature_estimates_similarity():
    a = minhash.shingle_set(" ".join(f"x{i}" for i in range(1000)).encode())
    b = minhash.shingle_set(" ".join(f"x{i}" for i in range(100, 1000)).encode())
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(same - exact) < 0.12 and exact > 0.85
    assert SF


def brute_at(rows, percent):
    """Component of each id by exact similarity of all pairs, at any threshold."""
    sets = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in sets}
    for k, (i, s) in enumerate(sets):
        for j, x in sets[:k]:
            if s and x and 100 * len(s & x) >= percent * len(s | x) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = {v: low if c == high else c for v, c in comp.items()}
    return comp


def test_match_bound_follows_the_similarity():
    assert minhash.match_bound((85, 100)) == 92 and minhash.match_bound((80, 100)) == 84


def test_similarity_is_a_parameter(spark):
    """Pairs between 0.80 and 0.85 are links at 0.8 only."""
    rows = []
    for k in range(40):
        words = [f"d{k}x{i}" for i in range(304)]
        near = words[: 300 - k] + [f"n{k}x{i}" for i in range(k + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at80, at85 = brute_at(rows, 80), brute_at(rows, 85)
    assert at80 != at85
    assert {r["id"]: r["component_id"] for r in minhash.near_duplicates(docs, share=(80, 100)).collect()} == at80
    assert {r["id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == at85


def test_pipeline_stage_takes_080(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_at(rows, 80)
    assert want != brute_at(rows, 85)
    near = dict(P.STAGES)["near_dedup"](spark, docs, SF)
    assert {r["doc_id"] for r in near.collect()} == {i for i, c in want.items() if i == c} and near.columns == docs.columns
