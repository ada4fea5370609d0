"""The driver contract: entry() runs; every query with an oracle matches DuckDB on sf0.001."""

import importlib.util
import os

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def _load():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


_MOD = None


def _entry():
    global _MOD
    if _MOD is None:
        _MOD = _load()
    return _MOD


def _norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


def test_entry_runs(spark):
    df = _entry().entry(spark)
    rows = df.collect()
    assert df.columns == ["rank", "feature", "score"] and len(rows) == 5


def test_every_query_has_an_oracle():
    from infosieve.plans.oracle import ORACLE
    from infosieve.plans.queries import QUERIES
    assert set(QUERIES) == set(ORACLE) <= set(_entry().queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(_entry().oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    e = _entry()
    df = e.queries()[name](spark, SF)
    got = sorted((tuple(_norm(x) for x in r) for r in df.collect()), key=repr)
    rel = con.sql(e.oracle_sql()[name])
    order = [rel.columns.index(c) for c in df.columns]
    want = sorted((tuple(_norm(r[i]) for i in order) for r in rel.fetchall()), key=repr)
    assert got == want
