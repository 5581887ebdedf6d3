"""What plans must look like: relational operators stay in the JVM, scans read what they need, ranges are no cross joins."""

from __future__ import annotations

import os

import pytest

from pageloom.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
#: Folds whose every step depends on the one before.
FOLDS = {"lru_state", "fifo_state", "closed_stack"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - FOLDS - {"stream_settings"}))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(catalogue.QUERIES[name](spark, SF))
    assert not [x for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin") if x in text]


def test_scans_read_only_what_they_need(spark):
    text = plan(catalogue.QUERIES["search_pages"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "Exchange" not in text
    text = plan(catalogue.QUERIES["footprints"](spark, SF))
    assert "l_shipdate" not in text
