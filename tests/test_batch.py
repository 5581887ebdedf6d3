"""Requests of one table: what each operation makes, what each check says, and that bad ones harm no others."""

from __future__ import annotations

from pyspark.sql import Observation

from pageloom.operators import batch

REQUESTS = "request_id int, doc_id string, op string, pages array<int>, degrees int, size int"


def test_requests(spark):
    pages = spark.createDataFrame([(d, p) for d, n in (("a", 5), ("b", 1)) for p in range(1, n + 1)], "doc_id string, page int")
    good = [
        (1, "a", "rotate", None, 90, None, [[(p, 90) for p in range(1, 6)]]), (2, "a", "rotate", [2, 9], 180, None, [[(p, 180 * (p == 2)) for p in range(1, 6)]]),
        (3, "a", "remove", [2, 2, 4], None, None, [[(1, 0), (3, 0), (5, 0)]]), (4, "a", "reorder", [5, 4, 1, 2, 3], None, None, [[(p, 0) for p in (5, 4, 1, 2, 3)]]),
        (5, "a", "extract", [3, 3, 1], None, None, [[(3, 0), (3, 0), (1, 0)]]), (6, "a", "split", None, None, 2, [[(1, 0), (2, 0)], [(3, 0), (4, 0)], [(5, 0)]]),
        (7, "b", "reverse", None, None, None, [[(1, 0)]]), (8, "b", "split", None, None, 9, [[(1, 0)]]),
    ]
    bad = [
        (11, "c", "rotate", None, 90, None, "not found", "no such document"), (12, None, "rotate", None, 90, None, "not found", "no such document"), (13, "a", "burn", None, None, None, "invalid input", "unknown operation burn"),
        (14, "a", None, None, None, None, "invalid input", "unknown operation null"), (15, "a", "rotate", None, 45, None, "invalid input", "Degrees must be 90, 180, or 270"), (16, "a", "rotate", None, None, None, "invalid input", "Degrees must be 90, 180, or 270"),
        (17, "a", "remove", [], None, None, "invalid input", "No pages specified"), (18, "a", "remove", [1, 0, 9], None, None, "invalid input", "Page 0 out of range (1-5)"), (19, "b", "remove", [1], None, None, "invalid input", "Cannot remove all pages from a PDF"),
        (20, "a", "reorder", [1, 2], None, None, "invalid input", "Order length 2 doesn't match page count 5"), (21, "a", "reorder", [1, 2, 3, 4, 6], None, None, "invalid input", "Page 6 out of range (1-5)"), (22, "a", "reorder", [1, 2, 3, 3, 1], None, None, "invalid input", "Page 3 appears more than once in order"),
        (23, "a", "extract", None, None, None, "invalid input", "No pages specified"), (24, "a", "extract", [None, 1], None, None, "invalid input", "Page null out of range (1-5)"), (25, "a", "split", None, None, 0, "invalid input", "Pages per file must be at least 1"), (26, "a", "split", None, None, None, "invalid input", "Pages per file must be at least 1"),
    ]
    seen = Observation()
    out = batch.run(spark.createDataFrame([r[:6] for r in good + bad], REQUESTS), pages, seen)
    made = {}
    for r in out.pages.collect():
        made.setdefault(r.request_id, {})[r.part, r.position] = (r.page, r.turn)
    assert made == {g[0]: {(i + 1, j + 1): x for i, part in enumerate(g[6]) for j, x in enumerate(part)} for g in good}
    assert {r.request_id: (r.doc_id, r.op, r.code, r.message) for r in out.errors.collect()} == {b[0]: (b[1], b[2], *b[6:]) for b in bad}
    assert seen.get == {"done": len(good), "failed": len(bad), "total": len(good) + len(bad)}
    none = batch.run(spark.createDataFrame([], REQUESTS), pages)
    assert none.pages.count() == 0 and none.errors.count() == 0
