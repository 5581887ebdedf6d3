"""Queries on documents over tables that the test data do not hold."""

from __future__ import annotations

import datetime

import duckdb

from pageloom.plans import documents

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"


def test_bookmarks_to_parts_a_million_apart(spark, tmp_path):
    day = datetime.datetime(2020, 1, 1)
    rows = [(k, p, 1, n, 1.0, 1.0, 0.0, 0.0, day) for k in (1, 2) for n, p in enumerate((7, 1_000_007, 8, 1_000_008, 2_000_007 + k), 1)]
    spark.createDataFrame(rows, LINES).write.parquet(str(tmp_path / "lineitem.parquet"))
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(documents.ORACLES["bookmark_pages"]).fetchall())
    got = documents.bookmark_pages(spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select("doc_id", "ord", "page").collect()) == want and len(want) == 5
