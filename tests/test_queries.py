"""Every registered query with a twin, on the smallest tables, against DuckDB."""

import math
import os

import duckdb
import pytest

from tessera import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        p = f"{SF}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 7))
    return str(v)


def rows(table):
    cols = sorted(table.column_names)
    return cols, sorted(tuple(map(plain, r)) for r in zip(*[table.column(c).to_pylist() for c in cols]))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toArrow()
    assert len(set(got.column_names)) == len(got.column_names)
    if name in catalog.ORACLES:
        assert rows(got) == rows(con.sql(catalog.ORACLES[name]).to_arrow_table())
