import duckdb
import pytest

from graphloom.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = registry.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(want, key=str)
