"""Each registered query of the engine against its SQL on DuckDB."""

from pathlib import Path

import duckdb
import pytest

from quern.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df):
    return sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, data, name):
    got = QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = db.sql(ORACLE_SQL[name]).df()
    assert sorted(want.columns) == columns
    assert rows(got.select(columns).toPandas()) == rows(want[columns])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def _tied(n: int) -> str:
    """The first and the fifth sentence have equal scores but for the rounding of doubles."""
    w = [chr(97 + i // 26) + chr(97 + i % 26) + "x" for i in range(n + 15)]
    return " ".join(w[:n]) + ". Aa aa. Aa aa. Aa aa. " + " ".join(w) + "."


@pytest.mark.parametrize("name", ["compress_batch_multi_question", "compress_flagship", "compress_threshold", "dedup_prep", "selection_report", "udtf_compress"])
def test_scores_equal_but_for_rounding_are_ties(spark, tmp_path, name):
    more = f" {'the end ' * 30}." if name == "compress_batch_multi_question" else ""  # ranked first, it leaves room for one of the two
    spark.createDataFrame([(n, _tied(n) + more) for n in range(1, 15)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = [(n, t, "user", "the end " * t * 5) for n in range(1, 15) for t in (1, 10, 20, 40)]
    spark.createDataFrame(asked, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    assert rows(got.select(columns).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df()[columns])
