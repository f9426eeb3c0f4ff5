"""The driver's contract, and all queries with SQL against DuckDB on the smallest tables."""

import importlib
import os

import pytest

import __spark_entry__ as entry
from kvlake.plans import catalog, stores

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    return sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in found)


@needs_tables
def test_entry(spark):
    assert entry.entry(spark).columns == ["key", "value"] and entry.entry(spark).count() > 0


@needs_tables
@pytest.mark.parametrize("name", sorted({**catalog.ORACLES, **stores.ORACLES}))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = {**catalog.QUERIES, **stores.QUERIES}[name](spark, SF)
    sql = con.execute({**catalog.ORACLES, **stores.ORACLES}[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in sql.description], sql.fetchall())


def test_registry_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_operators(monkeypatch):
    monkeypatch.setattr(entry, "find_spec", lambda name: None)
    assert set(entry.queries()) == {*catalog.QUERIES, *stores.QUERIES} and set(entry.oracle_sql()) == {*catalog.ORACLES, *stores.ORACLES}


def test_nothing_else_imports_the_corpus_operators():
    import kvlake

    root = os.path.dirname(kvlake.__file__)
    for folder, _, names in os.walk(root):
        for n in names:
            if n.endswith(".py") and f"{os.sep}llm" not in folder:
                with open(os.path.join(folder, n)) as f:
                    assert "kvlake.llm" not in f.read(), n
    importlib.reload(entry)
