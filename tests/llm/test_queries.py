"""The registered queries: contracts on the small tables, and SQL where it exists."""

import duckdb
import pytest
from common_llm import SF

import __spark_entry__ as E
from chorus.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(Q.ORACLES[name])
    cols = [d[0] for d in res.description]
    df = Q.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, res.fetchall()))


CONTRACT = {
    "op1_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op2_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_multi_index": ["query_id", "rank", "vec_id", "score"],
    "op7_minhash": ["doc_id", "n_shingles", "component_id", "kept"],
    "op8_pivots": ["vec_id", "n_links", "component_id", "kept"],
    "op9_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op11_repacking": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op12_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
    "op13_importance": ["doc_id", "n_features", "weight", "score", "rank"],
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract_columns(spark, name):
    df = E.queries()[name](spark, SF)
    assert set(CONTRACT[name]) <= set(df.columns)
    assert df.count() > 0


def test_pipeline_is_registered():
    assert "pipeline" in E.queries() and len([n for n in E.queries() if n.startswith("op")]) == 13
