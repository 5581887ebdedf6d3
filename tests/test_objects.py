"""Chains of revisions and merged objects on hand-made tables."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from pageloom import storage
from pageloom.operators import canonical, merging, revisions

SECTIONS = "doc int, offset long, prev long, stm long"


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, 10, None, None), (1, 20, 10, 25), (1, 25, 999, None), (1, 30, 20, None)]  # a stream table's own way back is not gone
    rows += [(2, 1, 3, None), (2, 2, 1, None), (2, 3, 2, None)]  # a circle
    rows += [(3, 5, 4, None), (4, 5, None, 6), (7, 1, 1, None)]  # a section and a stream table are missing; a section leads to itself
    rows += [(d, i, i - 1 if i else None, None) for d, n in ((5, 512), (6, 513)) for i in range(n)]
    starts = [(1, 30), (2, 2), (3, 5), (4, 5), (5, 511), (6, 512), (7, 1), (8, 1)]
    return revisions.chain(spark.createDataFrame(rows, SECTIONS), spark.createDataFrame(starts, "doc int, offset long"))


def test_chains(found):
    ranks = {(r.doc, r.offset): r.rank for r in found.sections.collect()}
    want = {(1, 30): 0, (1, 20): 1, (1, 10): 2, (2, 2): 0, (2, 1): 1, (2, 3): 2, (7, 1): 0}
    assert ranks == want | {(5, i): 511 - i for i in range(512)}
    assert {r.doc: r.error for r in found.errors.collect()} == {3: "a section is missing", 4: "a section is missing", 6: "the chain has more than 512 sections", 8: "a section is missing"}


def test_newest_entries(spark, found):
    entries = [(1, 10, 1, "old"), (1, 20, 1, "table"), (1, 25, 1, "stream"), (1, 20, 2, "table"), (1, 10, 3, "old"), (1, 30, 3, "new"), (1, 999, 4, "nowhere"), (3, 5, 1, "of an error"), (2, 3, 1, "far"), (2, 1, 1, "near")]
    got = revisions.newest(found, spark.createDataFrame(entries, "doc int, offset long, num int, entry string"), ["num"], ["entry"])
    assert {(r.doc, r.num): r.entry for r in got.collect()} == {(1, 1): "stream", (1, 2): "table", (1, 3): "new", (2, 1): "near"}


@pytest.mark.parametrize("seed", range(3))
def test_chains_over_units_of_any_cut(spark, seed):
    """Units of five sections: ways that cross them back and forth, circles, gaps and long chains, against a plain walk."""
    draw = random.Random(seed)
    rows, starts, want = [], [], {}
    for doc in range(40):
        n = draw.choice([1, 4, 23, 60])
        offsets = draw.sample(range(2**53, 2**53 + 200), n)
        links = {o: (None if draw.random() < 0.05 else draw.choice(offsets) if draw.random() < 0.1 else offsets[i - 1] if i else draw.choice([None, 5])) for i, o in enumerate(offsets)}
        streams = {o: draw.choice([None] * 40 + [7, offsets[0]]) for o in offsets}
        rows += [(doc, o, p, streams[o]) for o, p in links.items()]
        starts.append((doc, offsets[-1]))
        way, at = [], offsets[-1]
        while at is not None and at not in way:
            way.append(at)
            at = links.get(at)
        bad = any(o not in links or streams[o] is not None and streams[o] not in links for o in way)
        want[doc] = "the chain has more than 30 sections" if len(way) > 30 else "a section is missing" if bad else way
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        out = revisions.chain(spark.createDataFrame(rows, SECTIONS).repartition(3), spark.createDataFrame(starts, "doc int, offset long"), 30)
        got = {r.doc: r.error for r in out.errors.collect()}
        for r in sorted(out.sections.collect(), key=lambda r: r.rank):
            got.setdefault(r.doc, []).append(r.offset)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_chains_inside_units_take_few_rounds(spark, monkeypatch):
    """Chains of five hundred sections in a unit each: no round of doubling over all sections."""
    counts = []
    kept = revisions.checkpointed
    monkeypatch.setattr(revisions, "checkpointed", lambda df: counts.append(1) or kept(df))
    rows = spark.range(1500).select((F.col("id") % 3).cast("int").alias("doc"), F.floor(F.col("id") / 3).alias("offset"))
    rows = rows.select("doc", "offset", F.when(F.col("offset") > 0, F.col("offset") - 1).alias("prev"), F.lit(None).cast("long").alias("stm"))
    out = revisions.chain(rows, spark.createDataFrame([(d, 499) for d in range(3)], "doc int, offset long"))
    assert out.sections.filter("rank = 499 - offset").count() == 1500 and out.errors.isEmpty() and len(counts) <= 8


def test_no_sections(spark, found):
    none = revisions.chain(spark.createDataFrame([], SECTIONS), spark.createDataFrame([], "doc int, offset long"))
    assert none.sections.count() == 0 and none.errors.count() == 0


def test_merged_documents(spark):
    """Two documents, the first of them twice; a second level of page nodes, an outline, references to nothing."""
    objects = [("a", 1, "Catalog"), ("a", 3, "Pages"), ("a", 5, "Page"), ("a", 9, None), ("a", 7, "Outlines"), ("b", 2, "Pages"), ("b", 4, "Pages"), ("b", 6, "Page"), ("b", 8, "Catalog"), ("b", 10, "Font")]
    edges = [("a", 1, 3), ("a", 1, 7), ("a", 3, 5), ("a", 5, 3), ("a", 5, 9), ("a", 9, 99), ("a", 9, 9), ("b", 8, 2), ("b", 2, 4), ("b", 4, 6), ("b", 6, 4), ("b", 6, 10), ("b", 4, 10), ("b", 8, 10), ("b", 10, 8)]
    order = [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "b"), (3, 1, "none")]
    out = merging.merge_objects(spark.createDataFrame(objects, "doc_id string, id int, kind string"), spark.createDataFrame(edges, "doc_id string, src int, dst int"), spark.createDataFrame(order, "merged_id int, ord int, doc_id string"))
    got = {(r.merged_id, r.num): (r.kind, r.doc_id, r.id) for r in out.objects.collect()}
    first = {1: ("Catalog", "a", 1), 2: ("Pages", "a", 3), 3: ("Page", "a", 5), 4: ("", "a", 9), 5: ("Page", "b", 6), 6: ("Font", "b", 10), 7: ("Page", "a", 5), 8: ("", "a", 9)}
    second = {1: ("Pages", "b", 2), 2: ("Page", "b", 6), 3: ("Catalog", "b", 8), 4: ("Font", "b", 10)}
    assert got == {(1, n): x for n, x in first.items()} | {(2, n): x for n, x in second.items()}
    links = {1: {(1, 2), (2, 3), (3, 2), (3, 4), (4, 4), (2, 5), (5, 2), (5, 6), (2, 6), (6, 1), (2, 7), (7, 2), (7, 8), (8, 8)}, 2: {(3, 1), (1, 2), (2, 1), (2, 4), (1, 4), (3, 4), (4, 3)}}
    rows = out.edges.collect()
    assert {m: {(r.src, r.dst) for r in rows if r.merged_id == m} for m in (1, 2)} == links and len(rows) == sum(map(len, links.values()))
    nothing = merging.merge_objects(spark.createDataFrame([], "doc_id string, id int, kind string"), spark.createDataFrame([], "doc_id string, src int, dst int"), spark.createDataFrame(order, "merged_id int, ord int, doc_id string"))
    assert nothing.objects.count() == 0 and nothing.edges.count() == 0


def test_merged_objects_are_written_once(spark, monkeypatch):
    """Long documents over several ranges: a row is written once, and numbers have no gaps."""
    counts, kept = [], merging.checkpointed

    def counting(df):
        df = kept(df)
        counts.append(df.count())
        return df

    monkeypatch.setattr(merging, "checkpointed", counting)
    n, docs = 400, 6
    kind = F.when(F.col("id") % n == 37, "Catalog").when(F.col("id") % n == 90, "Pages").otherwise("Page")
    objects = spark.range(n * docs).select(F.floor(F.col("id") / n).cast("int").alias("doc_id"), F.col("id").alias("id"), kind.alias("kind"))
    order = spark.createDataFrame([(d % 2, -d, d) for d in range(docs)], "merged_id int, ord int, doc_id int")
    out = merging.merge_objects(objects, spark.createDataFrame([], "doc_id int, src long, dst long"), order)
    got = [(r.merged_id, r.num, r.kind, r.doc_id, r.id) for r in out.objects.collect()]
    want = []
    for first in (4, 5):
        row, docs_of = [], range(first, -1, -2)
        for d in docs_of:
            for i in range(d * n, d * n + n):
                if i % n not in (37, 90) or d == first:
                    body = (docs_of[-1], docs_of[-1] * n + 37) if i % n == 37 else (d, i)
                    row.append(({37: "Catalog", 90: "Pages"}.get(i % n, "Page"), *body))
        want += [(first % 2, at, *x) for at, x in enumerate(row, 1)]
    assert sorted(got) == sorted(want)
    assert sum(counts) <= n * docs + 100


def plain_merge(objects, edges, order):
    """Rows of objects and edges by one walk through the merged documents."""
    out, links = [], []
    for m in {r[0] for r in order}:
        rows = sorted((o, d, -99 if i is None else i, k or "") for mm, o, d in order if mm == m for dd, i, k in objects if dd == d and k not in merging.DROPPED)
        first, last = {}, {}
        for r in rows:
            first.setdefault(r[3], r)
            last[r[3]] = r
        numbered = [r for r in rows if r[3] not in merging.ONE_EACH or r == first[r[3]]]
        num = {r: n for n, r in enumerate(numbered, 1)}
        out += [(m, n, r[3], *(last if r[3] == "Catalog" else {r[3]: r})[r[3]][1:3]) for r, n in num.items()]
        at, found = {r[:3]: r for r in rows}, set()
        new = lambda r: num[first[r[3]] if r[3] in merging.ONE_EACH else r]  # noqa: E731, B023
        for o, d in {r[:2] for r in rows}:
            for a, b in ((at.get((o, d, x)), at.get((o, d, y))) for dd, x, y in edges if dd == d):
                if a and b and (a[3], b[3]) not in (("Page", "Pages"), ("Pages", "Page"), ("Pages", "Pages")) and (a[3] != "Catalog" or a == last["Catalog"]):
                    found.add((m, new(a), new(b)))
        if "Pages" in first:
            tree = num[first["Pages"]]
            found |= {(m, num[first["Catalog"]], tree)} if "Catalog" in first else set()
            found |= {x for r, n in num.items() if r[3] == "Page" for x in ((m, n, tree), (m, tree, n))}
        links += found
    return sorted(out), sorted(links)


@pytest.mark.parametrize("large", (merging.LARGE, 12))
def test_merged_documents_of_any_size(spark, large):
    """Several catalogues and page tree nodes a document, references that come twice or lead nowhere, documents above ``large``."""
    draw = random.Random(large)
    objects, edges = [(None, 1, "Page"), (8, 1, "Font")], [(None, 1, 1), (1, None, 1), (1, 1, None)]
    for doc in range(7):
        n = draw.choice([3, 9, 30])
        objects += [(doc, i, draw.choice(["Page", "Page", "Pages", "Catalog", "Font", None, "Outlines"])) for i in draw.sample(range(-9, 50), n)]
        edges += [(doc, *draw.choices(range(-9, 50), k=2)) for _ in range(n * n)]
    edges += edges[3::2]
    objects += [(7, None, "Catalog"), (7, 3, "Catalog"), (7, 4, "Page"), (7, None, "Font")]
    order = [(m, draw.randrange(3), d) for m in range(4) for d in draw.sample(range(9), 5)] + [(5, 1, 2), (5, 2, 2), (6, 0, 8)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    out = merging.merge_objects(frame(objects, "doc_id int, id int, kind string"), frame(edges, "doc_id int, src long, dst long"), frame(order, "merged_id int, ord int, doc_id int"), large)
    rows = [sorted(map(tuple, t.select(*c).collect()), key=str) for t, c in ((out.objects, ("merged_id", "num", "kind", "doc_id", "id")), (out.edges, ("merged_id", "src", "dst")))]
    rows[1].sort()
    rows[0] = sorted((*r[:4], -99 if r[4] is None else r[4]) for r in rows[0])
    assert tuple(rows) == plain_merge([o for o in objects if o[0] is not None], edges, order)


def test_references_are_dealt_once(spark):
    """Shuffled bytes a reference: with a shuffle for each of its ends and one against copies there were 26, now 17."""
    docs, n = 4_000, 20
    shuffled = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    objects = spark.range(docs * n).select(F.floor(F.col("id") / n).alias("doc_id"), (F.col("id") % n).alias("id"), F.when(F.col("id") % n == 0, "Catalog").when(F.col("id") % n == 1, "Pages").otherwise("Page").alias("kind"))
    edges = spark.range(docs * n * 2).select(F.floor(F.col("id") / (2 * n)).alias("doc_id"), (F.col("id") % n).alias("src"), ((F.col("id") % (2 * n)) * 7 % n).alias("dst"))
    order = spark.range(docs).select((F.col("id") % 5).alias("merged_id"), (-F.col("id")).alias("ord"), F.col("id").alias("doc_id"))
    tables = [storage.written(t) for t in (objects, edges, order)]
    before = shuffled()
    merging.merge_objects(*tables).edges.write.format("noop").mode("overwrite").save()
    time.sleep(1)
    assert shuffled() - before < 21 * docs * n * 2


def test_tables_of_generated_rows_have_their_true_size(spark):
    """A few keys that make many values each: what joins take for the size must not be that of the keys."""
    k = F.col("id")
    value = lambda n, parent, kind: F.struct((k * 10 + n).alias("id"), (k * 10 + parent if parent is not None else F.lit(None)).cast("long").alias("parent"), F.lit(f"N{n}").alias("name"), F.lit(n).alias("pos"), F.lit(kind).alias("kind"), (k % 7).cast("string").alias("value"))
    nodes = spark.range(4000).select(F.inline(F.array(value(0, None, "dict"), *[value(n, 0, "int") for n in range(1, 9)])))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")
    try:
        kept = storage.checkpointed(nodes)
        assert "BroadcastHashJoin" not in kept.join(kept.withColumnRenamed("value", "v"), "id")._jdf.queryExecution().executedPlan().toString()
        found = canonical.equal_objects(nodes, [])
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.filter("canonical <> id % 70").count() == 0 and found.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
