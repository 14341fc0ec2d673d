import math

import duckdb
import pytest

from panelwright.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def tidy(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, duck, sf, name):
    df = catalogue.queries()[name](spark, sf)
    expected = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    order = sorted(df.columns)
    ours = sorted((tuple(tidy(r[c]) for c in order) for r in df.collect()), key=repr)
    at = [expected.columns.index(c) for c in order]
    theirs = sorted((tuple(tidy(r[k]) for k in at) for r in expected.fetchall()), key=repr)
    assert ours and ours == theirs


def test_entry_works_without_the_corpus_modules(spark, monkeypatch):
    import importlib.util

    import __spark_entry__

    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("panelwright.llm", "corpus")) else find(name, *a))
    assert set(__spark_entry__.queries()) == set(catalogue.queries())
    assert __spark_entry__.entry(spark).columns == ["date", "code", "place", "mom", "rank"]
