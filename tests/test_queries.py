"""Every library query against its SQL in DuckDB, on the smallest tables."""

import math
from pathlib import Path

import pytest

from ferrolith.queries import ORACLE_SQL, QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, str(SF))
    wanted = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert _rows(found.columns, found.collect()) == _rows(wanted.columns, wanted.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_collisions_beyond_the_alphabet_equal_sql(spark, duck, tmp_path):
    duck.sql(f"copy (select i as s_suppkey, i % 3 as s_nationkey from range(90000) t(i)) to '{tmp_path}/supplier.parquet' (format parquet)")
    found = QUERIES["win_08_collisions"](spark, str(tmp_path))
    con = duck.cursor()
    con.sql(f"create temp view supplier as select * from '{tmp_path}/supplier.parquet'")
    assert _rows(found.columns, found.collect()) == _rows(found.columns, con.sql(ORACLE_SQL["win_08_collisions"]).project(", ".join(found.columns)).fetchall())
