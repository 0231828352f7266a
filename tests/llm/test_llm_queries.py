"""The registered queries: their contracts' columns, and their SQL where there is any."""

from pathlib import Path

import duckdb
import pytest

from quern.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_ngram_join": ["doc_id", "class_id", "n_links", "n_copies"],
    "op2_ann": ["query_id", "rank", "vec_id", "score"],
    "op3_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"],
    "op4_mixing": ["doc_id", "domain", "lang", "source", "n_tokens", "copies"],
    "op5_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6_html": ["page_id", "url", "text", "n_chars"],
    "op7_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op10_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_sql(spark, data, name):
    got = QUERIES[name](spark, data)
    assert got.columns == COLUMNS[name]
    df = got.toPandas()
    assert len(df) > 0
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for p in Path(data).glob("*.parquet"):
            con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.sql(ORACLE_SQL[name]).df()[got.columns]
        rows = lambda x: sorted(map(str, x.astype(object).where(x.notna(), None).values.tolist()))
        assert rows(df) == rows(want)
