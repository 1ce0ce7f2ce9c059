from common_llm import SF, edge_docs, empty_docs

import corpus_pipeline as P
from test_linedup import brute as clean_lines
from test_minhash import brute as classes

from chorus.llm import langid


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = P.language_id(spark, docs, SF)
    verdict = {r["doc_id"]: r["rejected"] for r in langid.identify(docs, langid.fit(docs)).collect()}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, gone in verdict.items() if not gone} and kept.columns == columns

    lines = P.line_dedup(spark, kept, SF)
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {i: t for (i, _), t in clean_lines(rows).items()}
    before = dict(rows)
    want = {i: t for i, t in want.items() if t == before[i] or t.strip(" ")}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want and lines.columns == columns
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    near = P.near_dedup(spark, lines, SF)
    comp = classes(list(want.items()))
    assert {r["doc_id"] for r in near.collect()} == {i for i, c in comp.items() if i == c} and near.columns == columns

    clean = P.mask_pii(spark, near, SF)
    assert clean.columns == columns and clean.count() == near.count()
    assert not clean.where("text rlike '[A-Za-z0-9]@[A-Za-z0-9-]+\\\\.[a-z]'").count()

    pieces = P.pack(spark, clean, SF)
    assert {r["doc_id"] for r in pieces.collect()} == {r["doc_id"] for r in clean.collect()}


def test_run_and_edges(spark):
    assert P.run(spark, SF).count() > 0
    for docs in (edge_docs(spark), empty_docs(spark)):
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            out.collect()
            if name != "packing":
                assert out.columns == docs.columns
                docs = out
