"""Every registered media query against its closed-form SQL, on small tables of the same shape as the driver's."""

import duckdb
import pytest

from siftreel.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT i AS o_orderkey FROM range(1, 161) t(i)")
    con.execute(
        "CREATE TABLE lineitem AS SELECT 1 + (i * 7) % 150 AS l_orderkey, 1 + i % 190 AS l_partkey, 1 + i % 9 AS l_suppkey, (1 + i % 4)::INTEGER AS l_linenumber, (i % 50)::DOUBLE AS l_quantity, i * 1.5 AS l_extendedprice FROM range(400) t(i)"
    )
    con.execute("CREATE TABLE part AS SELECT i AS p_partkey, 'type' || i AS p_type, (1 + i % 50)::INTEGER AS p_size FROM range(1, 120) t(i)")
    for t in ("orders", "lineitem", "part"):
        con.execute(f"COPY {t} TO '{d}/{t}.parquet' (FORMAT parquet)")
    return con, str(d)


def test_each_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    con, d = tables
    got = QUERIES[name](spark, d)
    want = con.execute(ORACLES[name])
    columns = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))
