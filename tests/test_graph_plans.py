"""The object graph's edges: made without a shuffle, given more than once without harm."""

from __future__ import annotations

from pageloom.operators import graph
from pageloom.plans import graph as plans


def test_edges_are_not_shuffled_before_the_walk(spark):
    edges = plans.object_edges(spark, "/root/testdata/sf0.001")
    assert "Exchange" not in edges._jdf.queryExecution().executedPlan().toString()


def test_edges_may_come_twice(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "a"), ("x", "y")], "src string, dst string")
    found = graph.reachable(edges, spark.createDataFrame([("a",)], "id string"), []).collect()
    assert sorted(r.id for r in found) == ["a", "b", "c"]
