"""Registered queries against their DuckDB oracles on the smallest fixture."""

import duckdb
import pytest

import __spark_entry__ as entry
from flagtide import registry
from flagtide.sources.tables import TABLES

registry.load_all()
SF = "/root/testdata/sf0.001"
# every query of the library that has an oracle; those of the optional part are
# compared in tests/llm
ALL = sorted(registry.ORACLES)


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ALL)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert _rows(df.columns, df.collect()) == _rows(d_cols, res.fetchall())


def test_every_query_has_a_callable():
    qs, orc = entry.queries(), entry.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 70


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
