"""Every query with SQL against DuckDB over the small tables, if these are there."""

import os

import pytest

from pagemill import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return con


def plain(value):
    return (value is None, str(round(value, 5) + 0.0) if isinstance(value, float) else str(value))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    want = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = want.fetchall()
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(map(plain, r)) for r in df.select(*columns).collect()]
    assert sorted(got) == sorted(tuple(map(plain, r)) for r in rows)
    assert rows or name in {"glossary_antijoin"}, "an empty result shows nothing"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_and_does_not_depend_on_partitions(spark, name):
    first = sorted(map(str, catalog.queries()[name](spark, SF).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert sorted(map(str, catalog.queries()[name](spark, SF).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert first
