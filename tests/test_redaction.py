"""Redaction against plain loops: boxes of all sizes, odd boxes, pages and documents that a region touches."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from pageloom.operators import redaction

BOX = "doc_id int, page int, n int, x0 double, y0 double, x1 double, y1 double"


def test_boxes_of_all_sizes_meet_once(spark):
    draw = random.Random(4)

    def box():
        size = draw.choice([0.0, 1e-9, 0.25, 1.0, 4.0, 37.0, 900.0])
        x, y = (draw.choice([draw.uniform(-500, 500), float(draw.randrange(-8, 8))]) for _ in "xy")
        return x, y, x + size, y + size * draw.choice([0.1, 1.0])

    boxes = [[(draw.choice([1, 2, None]), draw.randrange(3), n, *box()) for n in range(400)] for _ in range(2)]
    odd = [(1, 0, 900, 0.0, None, 1.0, 1.0), (1, 0, 901, 0.0, 0.0, float("inf"), 1.0), (1, 0, 902, float("nan"), 0.0, 1.0, 1.0)]
    glyphs, regions = (spark.createDataFrame(b + odd, BOX) for b in boxes)
    met = redaction.meetings(glyphs, regions.withColumnRenamed("n", "m"), ["doc_id", "page"], ["n"], ["m"]).collect()
    over = lambda a, b: a[3] < b[5] and a[5] > b[3] and a[4] < b[6] and a[6] > b[4]
    want = {(*a[:3], b[2]) for a in boxes[0] for b in boxes[1] if a[0] is not None and a[:2] == b[:2] and over(a, b)}
    assert {tuple(r) for r in met} == want
    assert len(met) == len(want) > 500
    left = redaction.without_met(glyphs, regions, ["doc_id", "page"])
    assert sorted(r.n for r in left.collect()) == sorted({a[2] for a in boxes[0] + odd} - {w[2] for w in want})
    assert redaction.without_met(glyphs, regions.limit(0), ["doc_id", "page"]).count() == glyphs.count()
    assert redaction.without_met(glyphs.limit(0), regions, ["doc_id", "page"]).count() == 0


def test_a_full_page_is_not_paired(spark):
    """A hundred thousand glyphs and ten thousand regions, one of them the whole page, another a column of it."""
    n = F.col("id")
    at = lambda step: [(n % 400 * step).alias("x0"), (F.floor(n / 400) * step).alias("y0"), (n % 400 * step + step * 0.9).alias("x1"), (F.floor(n / 400) * step + step * 0.9).alias("y1")]
    glyphs = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), n.alias("n"), *at(2.0))
    small = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), ((n * 37) % 100_000).alias("id")).select("doc_id", "page", *at(2.0))
    start = time.perf_counter()
    assert redaction.without_met(glyphs, small, ["doc_id", "page"]).count() == 90_000
    assert time.perf_counter() - start < 60
    column = small.limit(1).select("doc_id", "page", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1e6).alias("y1"))
    assert redaction.without_met(glyphs, small.unionByName(column), ["doc_id", "page"]).filter("n % 400 = 0").count() == 0
    page = column.withColumn("x1", F.lit(1e6))
    assert redaction.without_met(glyphs, small.unionByName(page), ["doc_id", "page"]).count() == 0


def test_redacted_documents(spark):
    glyphs = spark.createDataFrame([(1, 1, 1, 10.0, 10.0, 12.0, 12.0), (1, 1, 1, 10.0, 10.0, 12.0, 12.0), (1, 1, 2, 60.0, 10.0, 62.0, 12.0), (1, 2, 3, 10.0, 10.0, 12.0, 12.0), (2, 1, 4, 10.0, 10.0, 12.0, 12.0), (3, 1, 5, 1.0, 1.0, 2.0, 2.0)], BOX)
    pages = spark.createDataFrame([(d, p, 0.0, 0.0, 100.0, 200.0) for d in (1, 2, 3) for p in (1, 2)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    regions = spark.createDataFrame([(1, 0, 0.2, 0.1, 0.0, 0.0), (2, 7, 0.0, 0.0, 1.0, 1.0)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double")
    notes = spark.createDataFrame([(d, p, k) for d in (1, 2) for p in (1, 2) for k in (*redaction.TEXT_BEARING, "Link", None)], "doc_id int, page int, subtype string")
    info = spark.createDataFrame([(d, k) for d in (1, 2, 3) for k in ("Title", "Subject", "Producer", None)], "doc_id int, key string")
    out = redaction.redact(glyphs, notes, info, regions, pages)
    assert sorted(r.n for r in out.glyphs.collect()) == [2, 3, 4, 5]
    kept = {(r.doc_id, r.page) for r in out.annotations.filter("subtype = 'Text'").collect()}
    assert kept == {(1, 2), (2, 1), (2, 2)} and out.annotations.filter("subtype is null or subtype = 'Link'").count() == 8
    assert {(r.doc_id, r.key) for r in out.info.collect()} == {(1, "Producer"), (1, None), (2, "Producer"), (2, None), *((3, k) for k in ("Title", "Subject", "Producer", None))}
    same = redaction.redact(glyphs, notes, info, regions.limit(0), pages)
    assert (same.glyphs.count(), same.annotations.count(), same.info.count()) == (6, notes.count(), 12)
