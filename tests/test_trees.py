"""Walks against a plain depth-first walk: shared nodes, cycles, several roots, long chains."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import documents, trees

NODES = "doc int, id int, parent int, ord int"


def plain(rows):
    """(doc, id) to (parent, root, depth, n, size), by a walk that visits a node once."""
    out = {}
    for doc in {r[0] for r in rows}:
        kids, count = {}, 0
        for _, i, parent, at in {r for r in rows if r[0] == doc and r[1] is not None}:
            kids.setdefault(parent, set()).add((min(r[3] for r in rows if r[:3] == (doc, i, parent)), i))
        seen, todo = set(), [(i, None, i, 0) for _, i in sorted(kids.get(None, ()), reverse=True)]
        while todo:
            i, parent, root, depth = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            out[doc, i] = [parent, root, depth, count, 0]
            count += 1
            todo += [(k, i, root, depth + 1) for _, k in sorted(kids.get(i, ()), reverse=True)]
            at = i
            while at is not None:
                out[doc, at][4] += 1
                at = out[doc, at][0]
    return {k: tuple(v) for k, v in out.items()}


def walked(spark, rows):
    found = trees.walk(spark.createDataFrame(rows, NODES), ["doc"]).collect()
    got = {(r.doc, r.id): (r.parent, r.root, r.depth, r.n, r["size"]) for r in found}
    assert len(got) == len(found)
    return got


@pytest.mark.parametrize("seed", (1, 3))
def test_walk_of_any_graph(spark, seed):
    draw = random.Random(seed)
    rows = []
    for doc in (1, 2, 3):
        n = draw.choice([1, 12, 30])
        for i in range(n):
            for _ in range(draw.choice([1, 1, 1, 2, 3])):
                parent = None if i == 0 or draw.random() < 0.05 else draw.randrange(n if draw.random() < 0.15 * seed else i)
                rows.append((doc, i, parent, draw.randrange(4)))
    rows += [(4, 1, 2, 0), (4, 2, 1, 0), (4, 3, 1, 0)]
    assert walked(spark, rows) == plain(rows)


def test_ladder_of_diamonds(spark):
    """Ten diamonds, one under the other: 31 nodes, not the thousands of ways through them."""
    rows = [(1, 0, None, 0)]
    for d in range(10):
        top = 3 * d
        rows += [(1, top + 1, top, 2), (1, top + 2, top, 1), (1, top + 3, top + 1, 0), (1, top + 3, top + 2, 0)]
    got = walked(spark, rows)
    assert got == plain(rows) and len(got) == 31


def test_long_chain(spark, monkeypatch):
    """Twenty thousand nodes in a row: as many rounds as the length has bits."""
    counts = []
    kept = trees.checkpointed
    monkeypatch.setattr(trees, "checkpointed", lambda df: counts.append(1) or kept(df))
    n = 20_000
    nodes = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("id"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent"), F.lit(0).alias("ord"))
    out = trees.walk(nodes, ["doc"])
    assert out.filter("depth <> id or n <> id or size <> 20000 - id or not (root <=> 0) or not (parent <=> if(id = 0, null, id - 1))").count() == 0 and out.count() == n
    assert len(counts) <= 2 * 16 + 10
    far = trees.nearest_ancestor(nodes.withColumn("v", F.when(F.col("id") == 0, "top")), ["doc"], "v")
    assert far.filter("v <> 'top' or hops <> id or v is null").count() == 0


def test_star(spark):
    """All nodes under one."""
    rows = [(1, 0, None, 0)] + [(1, i, 0, -i % 7) for i in range(1, 3000)]
    assert walked(spark, rows) == plain(rows)


def test_ancestors_and_paths(spark):
    rows = [(1, 1, None, 0, "top"), (1, 2, 1, 1, None), (1, 3, 1, 0, "own"), (1, 4, 3, 0, None), (1, 5, 6, 0, None), (1, 6, 5, 0, None), (1, 7, 99, 0, None)]
    nodes = spark.createDataFrame(rows, NODES + ", v string")
    near = lambda **most: {r.id: (r.v, r.hops) for r in trees.nearest_ancestor(nodes, ["doc"], "v", **most).collect()}
    none = {5: (None, None), 6: (None, None), 7: (None, None)}
    assert near() == {1: ("top", 0), 2: ("top", 1), 3: ("own", 0), 4: ("own", 1)} | none
    assert near(most_hops=0) == {1: ("top", 0), 2: (None, None), 3: ("own", 0), 4: (None, None)} | none
    assert {r.id: r.path for r in trees.paths(nodes.select("doc", "id", "parent", F.col("id").alias("i")), ["doc"], "i").collect()} == {1: [1], 2: [1, 2], 3: [1, 3], 4: [1, 3, 4]}
    assert trees.walk(nodes.limit(0), ["doc"]).count() == 0 and trees.walk(nodes.filter("id > 4"), ["doc"]).count() == 0


def test_boxes_far_up(spark):
    chain = [(1, i, i - 1 if i else None, [612.0, 792.0, 0.0, 0.0] if i == 0 else None) for i in range(41)]
    odd = [(2, 1, None, [0.0, 0.0, 5.0, 0.0]), (2, 2, 1, [1.0, None, -3.0, 7.0]), (2, 3, 2, [0.0, 1.0, 2.0]), (3, 1, None, None)]
    nodes = spark.createDataFrame(chain + odd, "doc int, id int, parent int, box array<double>")
    got = {(r.doc, r.id): (r.width, r.height) for r in documents.page_sizes(nodes, ["doc"]).collect()}
    assert all(got[1, i] == (612.0, 792.0) for i in range(41))
    assert got[2, 1] == documents.A4 and got[2, 2] == got[2, 3] == (4.0, 7.0) and got[3, 1] == documents.A4


@pytest.mark.parametrize("shared", (False, True))
def test_leaves_stay_out_of_the_rounds(spark, monkeypatch, shared):
    """Of a wide tree few tables hold all nodes, whatever the rounds: the leaves are met before and after them."""
    counts = []

    def counting(kept):
        def of(df):
            df = kept(df)
            counts.append(df.count())
            return df

        return of

    monkeypatch.setattr(trees, "checkpointed", counting(trees.checkpointed))
    monkeypatch.setattr(trees, "written", counting(trees.written))
    rows = [(1, 0, None, 0)] + [(1, i, i - 1, 0) for i in range(1, 30)] + [(1, i, i % 30, i % 5) for i in range(30, 1000)]
    rows += [(1, 31, 3, 0)] if shared else []
    assert walked(spark, rows) == plain(rows)
    assert sum(n >= 900 for n in counts) <= (6 if shared else 3)
    counts.clear()
    nodes = spark.createDataFrame(rows, NODES).filter("id <> 31").withColumn("more", F.col("ord"))
    got = {r.id: (r.path, r.more) for r in trees.paths(nodes, ["doc"], "id", ["more"]).collect()}
    assert got == {i: ([*range(0, (i if i < 30 else i % 30) + 1)] + [i] * (i >= 30), at) for _, i, _, at in rows if i != 31}
    assert max(counts) <= 30
