"""Every query of the library against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from pageloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    value = lambda x: "null" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.6f}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(value, r)) for r in rows)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    sql = catalogue.ORACLES[name]
    assert columns == sorted(con.sql(sql).columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert plain(got.select(*columns).collect()) == plain(con.sql(f"select {quoted} from ({sql}) q").fetchall())
