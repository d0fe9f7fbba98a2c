"""Every registered query against its DuckDB oracle on the smallest tables (the driver's check at sf0.001)."""
import math

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from textguard.sources.tables import TABLES

ORACLES = entry.oracle_sql()


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 6))
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    own = {name for name in entry.queries() if not name.startswith("op") and name != "pipeline"}  # the others: tests/llm
    rows_only = own - set(ORACLES)
    assert rows_only == set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rel = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    s = sorted(tuple(_norm(r[c]) for c in order) for r in df.collect())
    idx = [rel.columns.index(c) for c in order]
    d = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert s == d


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["doc_id", "anonymized_text", "pii_count", "strategy"]
