"""Queries against their SQL over small tables made for a case that the driver's tables seldom hold."""

from pagemill import catalog


def both(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for path in folder.iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    got = catalog.queries()[name](spark, str(folder))
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    return sorted(map(tuple, got.select(*columns).collect())), sorted(want.fetchall())


def items(folder, rows):
    """orders and lineitem of (order, line, part, flag)."""
    import duckdb

    values = ", ".join(f"({o}, {n}, {p}, '{f}')" for o, n, p, f in rows)
    duckdb.sql(f"SELECT o::BIGINT AS l_orderkey, p::BIGINT AS l_partkey, 1::BIGINT AS l_suppkey, n::INTEGER AS l_linenumber, 3::DOUBLE AS l_quantity, 5::DOUBLE AS l_extendedprice, 0.05::DOUBLE AS l_discount, 0.02::DOUBLE AS l_tax, f AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2001-01-01' AS l_shipdate FROM (VALUES {values}) t(o, n, p, f)").write_parquet(str(folder / "lineitem.parquet"))
    duckdb.sql(f"SELECT DISTINCT o::BIGINT AS o_orderkey, 1::BIGINT AS o_custkey, 'O' AS o_orderstatus, 5::DOUBLE AS o_totalprice, TIMESTAMP '2001-01-01' AS o_orderdate, '1' AS o_orderpriority FROM (VALUES {values}) t(o, n, p, f)").write_parquet(str(folder / "orders.parquet"))


def test_image_with_the_number_of_its_figure(spark, tmp_path):
    """Figure 26 holds images 26, 28 and 44; only those divisible by 4 are usable."""
    items(tmp_path, [(2, 6, 26, "A"), (2, 1, 7, "N"), (3, 6, 44, "A"), (4, 5, 30, "A")])
    got, want = both(spark, tmp_path, "figure_resources")
    assert got == want and (26, "28,44") in got
