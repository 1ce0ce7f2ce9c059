from common_llm import CLASH, ROWS, SF, edge_docs, empty_docs

from chorus.llm import linedup


def brute(rows):
    """Cleaned texts by a sequential pass over all windows in (doc_id, line) order."""
    order = sorted({(-1 if i is None else i, i is not None, t) for i, t in rows if t is not None})
    seen, gone = {}, {}
    spots = sorted((i, p, t) for i, _, t in order for p in range(len(t.split("\n")) - 2))
    for i, p, t in spots:
        w = tuple(x.encode().strip() for x in t.split("\n")[p : p + 3])
        if any(w) and seen.setdefault(w, (i, p)) != (i, p):
            gone.setdefault((i, t), set()).update((p, p + 1, p + 2))
    return {
        (i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for i, _, t in order
    }


def test_against_sequential_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = linedup.dedup_lines(docs).collect()
    assert len(got) == len(texts)
    assert sum(r["n_removed"] for r in got) > 0
    for r in got:
        assert r["text"] == want[(r["doc_id"], texts[r["doc_id"]])]


def test_edges(spark):
    docs = edge_docs(spark)
    out = linedup.dedup_lines(docs)
    assert set(out.columns) == set(docs.columns)  # n_lines and n_removed replace the input's
    want = brute([(i, t) for i, t, _ in ROWS])
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted(((i, None if t is None else want[(-1 if i is None else i, t)]) for i, t, _ in ROWS), key=str)
    assert all(r["th"] == "x" and r["_c0"] == "x" for r in out.collect()) and "th" in CLASH
    assert linedup.dedup_lines(empty_docs(spark)).count() == 0


def test_windows_overlap_and_merge(spark):
    a = "a\nb\nc\nd\ne"
    out = linedup.dedup_lines(spark.createDataFrame([(1, a), (2, "x\n" + a + "\ny"), (3, "a\nb\nq")], "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: a, 2: "x\ny", 3: "a\nb\nq"}


def _prose(seed, n):
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def test_passages_on_one_line(spark):
    """A passage of 50 words and more that fills no window of three lines goes once only."""
    shared = " ".join(_prose(1, 60))
    two = " ".join(_prose(2, 20)) + "\n" + " ".join(_prose(3, 40))
    inside = _prose(4, 50)
    rows = [
        (1, "one\n" + shared + "\ntwo"), (2, shared), (3, "three\n  " + shared), (4, "x\n" + two), (5, two + "\ny"),
        (6, " ".join(_prose(5, 30) + inside + _prose(6, 30))), (7, "q " + " ".join(inside) + " r\nlast"),
        (8, " ".join(_prose(7, 33))), (9, " ".join(_prose(7, 33))), (10, "spam " * 500), (11, None), (12, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in linedup.dedup_lines(docs, passages=True).collect()}
    assert len(got) == len(rows)
    for i, want in {1: rows[0][1], 2: "", 3: "three", 4: rows[3][1], 5: "y", 6: rows[5][1], 8: rows[7][1], 9: rows[8][1], 11: None, 12: ""}.items():
        assert got[i] == want, i
    words = got[7].split()  # up to 16 words stay at either end inside a line
    assert words[0] == "q" and words[-2:] == ["r", "last"] and len(words) <= 3 + 32 and got[7].endswith("\nlast")
    assert "spam" in got[10] and len(got[10]) < 300
    assert got[2] != {r["doc_id"]: r["text"] for r in linedup.dedup_lines(docs).collect()}[2]


def test_copies_of_50_words_always_share_a_run():
    for seed in range(300):
        passage, outside = _prose(seed, 50), _prose(seed + 1000, 200)
        a = " ".join(outside[: seed % 60] + passage + outside[60:100]).encode().split(b"\n")
        b = " ".join(outside[100:130] + passage + outside[130 : 130 + seed % 70]).encode().split(b"\n")
        assert {c for _, c in linedup._runs(a)} & {c for _, c in linedup._runs(b)}


def test_pipeline_keeps_one_copy_of_a_long_line(spark):
    from collections import Counter

    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = dict(P.STAGES)["line_dedup"](spark, docs, SF)
    assert out.columns == docs.columns
    lines = Counter(x.strip() for r in out.collect() for x in (r["text"] or "").split("\n") if len(x.split()) >= 34)
    assert lines and max(lines.values()) == 1
