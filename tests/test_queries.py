"""Every registered query against its SQL, on the smallest dataset."""

import os

import duckdb
import pytest

from veinwork.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def texts(frame, columns):
    return frame[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), db.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    assert texts(got, columns).equals(texts(want, columns))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_text_operators(monkeypatch):
    """Missing, empty or broken, they take none of the other queries with them."""
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("veinwork.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "veinwork.llm", None)
    assert __spark_entry__.queries().keys() == catalogue.QUERIES.keys()
    assert __spark_entry__.oracle_sql().keys() == catalogue.ORACLE_SQL.keys()
    monkeypatch.delitem(sys.modules, "veinwork.llm")
    monkeypatch.setitem(sys.modules, "pyarrow", None)
    if __import__("importlib.util").util.find_spec("veinwork.llm"):
        with pytest.warns(UserWarning, match="pyarrow"):
            assert __spark_entry__.queries().keys() == catalogue.QUERIES.keys()
