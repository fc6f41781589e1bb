"""Queries with SQL against DuckDB over the small tables, if these are there."""

import datetime
import os

import pytest

from pagemill.llm import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    key = lambda row: tuple((v is None, str(v) if not isinstance(v, datetime.datetime) else v.isoformat()) for v in row)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(map(tuple, want.fetchall()), key=key)
