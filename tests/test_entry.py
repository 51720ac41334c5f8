import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom import queries as core

DIR = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert core.QUERIES.keys() == core.ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = core.QUERIES[name](spark, DIR)
    cols = sorted(got.columns)
    want = db.sql(f"SELECT {', '.join(cols)} FROM ({core.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == sorted(want, key=str)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("gone", ["corpus_pipeline", "graphloom.llm"])
def test_core_works_without_the_training_data_part(monkeypatch, gone):
    monkeypatch.setitem(sys.modules, gone, None)
    if gone == "graphloom.llm":  # as where its folder is deleted and the pipeline's file is not
        for name in [n for n in sys.modules if n.startswith("graphloom.llm.") or n == "corpus_pipeline"]:
            monkeypatch.delitem(sys.modules, name)
        import graphloom

        monkeypatch.delattr(graphloom, "llm", raising=False)
    assert importlib.reload(entry).queries().keys() == core.QUERIES.keys()
    assert entry.oracle_sql().keys() == core.ORACLE_SQL.keys()
    monkeypatch.undo()
    importlib.reload(entry)
