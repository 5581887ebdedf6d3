"""Operators on small tables made by hand: known values, round trips, and what must hold for any input."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pageloom import storage
from pageloom.functions import scalar
from pageloom.operators import annots, documents, forms, geometry, graph, labels, outline, sequence, state, text
from pageloom.operators.sums import sum_before


def rows(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def pages_of(spark, **sizes):
    return rows(spark, "doc_id string, page int, text string", *[(d, p, f"Page {p}") for d, n in sizes.items() for p in range(1, n + 1)])


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_search(spark):
    pages = rows(spark, "doc_id int, page int, text string", (1, 1, "Aaaa aA"), (1, 2, "none"), (2, 1, None), (2, 2, "a.a"))
    assert {(r.doc_id, r.page, r["count"]) for r in text.search_pages(pages, "AA").collect()} == {(1, 1, 3)}
    assert text.search_pages(pages, "").count() == 0
    assert {(r.page, r["count"]) for r in text.search_pages(pages, ".").collect()} == {(2, 1)}
    assert {(r.page, r["count"]) for r in text.search_highlights(pages, "aa").collect()} == {(1, 4)}
    assert [r.ordinal for r in text.search_hits(pages, "aa").orderBy("ordinal").collect()] == [1, 2, 3]


def test_pages_and_export(spark):
    docs = rows(spark, "doc_id int, text string", (1, "a\nb\nc\nd\ne"), (2, ""), (3, None))
    assert {(r.doc_id, r.page, r.text) for r in text.pages_of(docs).collect()} == {(1, 1, "a\nb\nc\nd\n"), (1, 2, "e\n"), (2, 1, "\n")}
    assert {r.doc_id: r.body for r in text.export_text(docs).collect()} == {1: "--- Page 1 ---\na\nb\nc\nd\n\n--- Page 2 ---\ne\n\n", 2: "--- Page 1 ---\n\n\n"}


def test_merge_keeps_all_pages(spark):
    pages = pages_of(spark, a=1, b=1, c=5)
    order = rows(spark, "merged_id int, ord int, doc_id string", (1, 1, "b"), (1, 2, "a"), (1, 3, "c"))
    got = sequence.merge_sequences(pages, order).orderBy("position").collect()
    assert [(r.position, r.doc_id, r.page) for r in got] == [(1, "b", 1), (2, "a", 1), *[(2 + p, "c", p) for p in range(1, 6)]]


def test_split(spark):
    pages = pages_of(spark, a=5)
    asked = rows(spark, "doc_id string, part int, start int, stop int", ("a", 1, 1, 2), ("a", 2, 3, 9), ("a", 3, 7, 8))
    got = {(r.part, r.position, r.page) for r in sequence.split_ranges(pages, asked).collect()}
    assert got == {(1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 2, 4), (2, 3, 5)}
    assert [r.part for r in sequence.range_errors(pages, asked).collect()] == [3]
    assert [(r.start, r.stop) for r in sequence.split_every(pages, 2).orderBy("part").collect()] == [(1, 2), (3, 4), (5, 5)]
    totals = rows(spark, "doc_id string, total int", ("a", 9))
    marks = rows(spark, "doc_id string, ord int, title string, page int", ("a", 1, "One", 2), ("a", 2, "same page", 2), ("a", 3, "T/w*o ", 5), ("a", 4, " ", 7))
    got = sequence.split_at_bookmarks(totals, marks).orderBy("part").collect()
    assert [(r.part, r.label, r.start, r.stop) for r in got] == [(1, "One", 2, 4), (2, "T_w_o", 5, 6), (3, "part3", 7, 9)]


def test_remove_reorder_move(spark):
    pages = pages_of(spark, a=5)
    gone = rows(spark, "doc_id string, page int", ("a", 2), ("a", 4), ("a", 4))
    assert [r.old_page for r in sequence.remove_pages(pages, gone).orderBy("page").collect()] == [1, 3, 5]
    every = pages.select("doc_id", "page")
    assert [r.message for r in sequence.removal_errors(pages, every).collect()] == ["no page would be left"]
    assert [r.message for r in sequence.removal_errors(pages, rows(spark, "doc_id string, page int", ("a", 6))).collect()] == ["page out of range"]
    order = rows(spark, "doc_id string, new_order array<int>", ("a", [5, 4, 3, 2, 1]))
    assert [r.old_page for r in sequence.reorder_pages(pages, order).orderBy("page").collect()] == [5, 4, 3, 2, 1]
    short = rows(spark, "doc_id string, new_order array<int>", ("a", [2, 1]))
    assert [r.old_page for r in sequence.reorder_pages(pages, short).orderBy("page").collect()] == [1, 2, 3, 4, 5]
    moves = rows(spark, "doc_id string, source int, target int", ("a", 4, 2))
    assert [r.old_page for r in sequence.move_page(pages, moves).orderBy("page").collect()] == [1, 4, 2, 3, 5]


@pytest.mark.parametrize(("asked", "want"), [("3", [3]), ("1-3", [1, 2, 3]), (" 2 , 5-6 ", [2, 5, 6]), ("3,1,3", [1, 3]), ("0,11,x,4-2,1.5", []), ("", []), ("1-2-3", [])])
def test_page_lists(spark, asked, want):
    assert value(spark, sequence.parse_pages(F.lit(asked), F.lit(10))) == want


def test_format_undoes_parse(spark):
    lists = rows(spark, "k int, asked string", (1, "1, 3-5, 7"), (2, "2"), (3, "1-10"))
    parsed = lists.select("k", F.explode(sequence.parse_pages(F.col("asked"), F.lit(10))).alias("page"))
    assert {r.k: r.pages for r in sequence.format_pages(parsed, "k").collect()} == {1: "1, 3-5, 7", 2: "2", 3: "1-10"}


def test_labels(spark):
    o = labels.Numbering("CASE-", "-A", digits=4)
    assert [value(spark, labels.number_label(F.lit(n), o)) for n in (7, 9999, 10000)] == ["CASE-0007-A", "CASE-9999-A", "CASE-10000-A"]
    stamped = labels.stamp_numbers(pages_of(spark, a=5), labels.Numbering("DOC", digits=4, increment=0))
    assert tuple(labels.stamp_report(stamped).first()) == ("a", "DOC0001", "DOC0005", 5)
    assert labels.page_numbers(pages_of(spark, a=1), 100).first().label == "100"
    out = labels.fill_template(F.lit("{filename} — page {page}/{total}"), F.lit(3), F.lit(12), F.lit("report.pdf"), F.lit("2020-01-01"))
    assert value(spark, out) == "report.pdf — page 3/12"
    nested = labels.fill_template(F.lit("{filename}"), F.lit(3), F.lit(12), F.lit("{date}"), F.lit("2020-01-01"))
    assert value(spark, nested) == "2020-01-01"


def test_overlay_comes_off_again(spark):
    contents = rows(spark, "doc_id string, page int, ord int, tag string, text string", ("a", 1, 0, None, "x"), ("a", 1, 1, None, "y"), ("a", 2, 0, "other", "z"))
    stamps = rows(spark, "doc_id string, page int, label string", ("a", 1, "1"), ("a", 2, "2"))
    for top in (False, True):
        stamped = labels.add_overlay(contents, stamps, "n", top)
        assert stamped.count() == 5
        assert sorted(labels.remove_overlay(stamped, "n").collect()) == sorted(contents.collect())


def cache(spark, *events):
    return rows(spark, "s int, n int, op string, key string", *[(1, i, op, k) for i, (op, k) in enumerate(events)])


def test_caches(spark):
    lru = lambda *e: state.lru_state(cache(spark, *e), ["s"], ["n"], "key", "op", 2).first()["keys"]
    assert lru(("set", "a"), ("set", "b"), ("set", "c")) == ["b", "c"]
    assert lru(("set", "a"), ("set", "b"), ("get", "a"), ("set", "c")) == ["a", "c"]
    assert lru(("set", "a"), ("set", "b"), ("set", "a"), ("set", "c")) == ["a", "c"]
    assert lru(("set", "a"), ("set", "b"), ("has", "a"), ("set", "c")) == ["b", "c"]
    assert lru(("set", "a"), ("set", "b"), ("set", "c"), ("get", "a"), ("set", "d")) == ["c", "d"]
    fifo = state.fifo_state(cache(spark, ("set", "a"), ("set", "b"), ("set", "a"), ("set", "c"), ("set", "a")), ["s"], ["n"], "key", 2).first()["keys"]
    assert fifo == ["c", "a"]
    stack = state.closed_stack(cache(spark, ("close", "a"), ("close", "b"), ("close", "a"), ("reopen", ""), ("close", "c")), ["s"], ["n"], "key", "op").first()["keys"]
    assert stack == ["b", "c"]


def test_library(spark):
    log = rows(spark, "path string, name string, flag string, on boolean, ts int, seq int", ("p", "n1", "starred", True, 1, 1), ("p", "n2", "archived", True, 2, 2), ("p", "n3", "starred", False, 3, 3))
    assert tuple(state.library_state(log).first()) == ("p", "n3", False, True, 1)
    log = rows(spark, "path string, page int, zoom double, ts int", ("p", 3, 1.0, 1), ("p", 10, 2.0, 2))
    latest = state.upsert_latest(log, ["path"], ["page", "zoom"], ["ts"])
    wanted = rows(spark, "path string", ("p",), ("q",))
    assert {tuple(r) for r in state.lookup(latest, wanted, ["path"], {"page": 1, "zoom": 1.0}).collect()} == {("p", 10, 2.0), ("q", 1, 1.0)}


def test_moves_and_free_names(spark):
    items = F.array(*[F.lit(c) for c in "abcd"])
    assert value(spark, state.moved(items, F.lit(0), F.lit(2))) == list("bcad")
    assert value(spark, state.moved(items, F.lit(3), F.lit(0))) == list("dabc")
    assert value(spark, state.moved(items, F.lit(4), F.lit(0))) == list("abcd")
    taken = rows(spark, "name string", ("a",), ("a-1",), ("a-3",), ("b-1",))
    got = {r.name: r.free for r in state.free_suffix(rows(spark, "name string", ("a",), ("b",)), taken).collect()}
    assert got == {"a": "a-2", "b": "b"}
    odd = rows(spark, "name string", ("a",), ("a",), ("a-1",), ("a-1-1",), ("a-01",), ("a-2",), (None,), ("",), ("-1",), ("b-c",), ("b",))
    asked = rows(spark, "name string", ("a",), ("a-1",), ("",), ("b",), ("b-c",), ("new",), (None,))
    assert {r.name: r.free for r in state.free_suffix(asked, odd).collect()} == {"a": "a-3", "a-1": "a-1-2", "": "-2", "b": "b-1", "b-c": "b-c-1", "new": "new"}
    assert {r.name: r.free for r in state.free_suffix(asked, odd.limit(0)).collect()} == {n: n for n in ("a", "a-1", "", "b", "b-c", "new")}


def test_a_name_with_many_numbers(spark):
    n = 100_000
    taken = spark.range(n).filter("id <> 77777").select(F.when(F.col("id") == 0, F.lit("x")).otherwise(F.concat(F.lit("x-"), F.col("id").cast("string"))).alias("name"))
    assert state.free_suffix(rows(spark, "name string", ("x",)), taken).first().free == "x-77777"


def test_today_is_utc(spark):
    before = dt.datetime.now(dt.UTC).date()
    spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")
    got = value(spark, labels.today())
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got in {str(before), str(dt.datetime.now(dt.UTC).date())}


def test_dedup(spark):
    objects = rows(spark, "doc int, id int, kind string, body string", (1, 2, "O", "x"), (1, 3, "O", "x"), (1, 4, "O", "y"), (1, 5, "Page", "x"), (1, 6, "Page", "x"), (1, 7, "S", "z" * 70_000), (1, 8, "S", "z" * 70_000), (1, 9, "O", None))
    mapping = graph.canonical(objects, ["doc"], "body")
    assert {r.id: r.canonical for r in mapping.collect()} == {2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}
    edges = rows(spark, "doc int, src int, dst int", (1, 4, 3), (1, 4, 2), (1, 3, 4), (1, 4, 99))
    assert sorted((r.src, r.dst) for r in graph.remap_edges(edges, mapping, ["doc"]).collect()) == [(4, 2), (4, 2), (4, 99)]
    again = graph.canonical(objects.join(mapping.filter("id = canonical").select("id"), "id", "left_semi").select(*objects.columns), ["doc"], "body")
    assert all(r.id == r.canonical for r in again.collect())


def test_reachability(spark):
    objects = rows(spark, "doc int, id int", *[(1, i) for i in (1, 2, 3, 4)], (2, 1), (2, 2))
    edges = rows(spark, "doc int, src int, dst int", (1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 1, 2))
    kept = graph.keep_reachable(objects, edges, rows(spark, "doc int, id int", (1, 1)), ["doc"])
    assert sorted(map(tuple, kept.collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]


def test_newest_revision(spark):
    xref = rows(spark, "num int, revision int, entry string", (1, 1, "old"), (1, 2, "new"), (2, 1, "x"))
    assert {r.num: r.entry for r in graph.newest_revision(xref, ["num"], "revision", ["entry"]).collect()} == {1: "new", 2: "x"}


def test_comment_conflicts(spark):
    note = "doc_id int, id string, text string, color string, created double, modified double"
    side = "doc_id int, id string, text string, color string, resolved boolean, created_at double, quote string, synced boolean, page int"
    notes = rows(spark, note, (1, "both", "outside edit", None, 5.0, None), (1, "new", "n", "#000000", None, 7.0))
    stored = rows(spark, side, (1, "both", "old", "#ffffff", True, 3.0, "q", True, 1), (1, "deleted", "d", "#fff", False, 1.0, None, True, 1), (1, "legacy", "l", "#fff", False, 1.0, None, False, 9))
    got = {r.id: tuple(r)[2:] for r in annots.load_comments(notes, stored).collect()}
    assert got == {"both": ("outside edit", "#ffffff", True, 3.0, "q", True), "new": ("n", "#000000", False, 7.0, None, True), "legacy": ("l", "#fff", False, 1.0, None, False)}
    pages = rows(spark, "doc_id int, page int", (1, 1))
    actions = {r.id: r.action for r in annots.comment_actions(notes, stored, pages).collect()}
    assert actions == {"both": "update", "new": "delete", "deleted": "insert", "legacy": "skip"}
    same = rows(spark, side, (1, "both", "outside edit", "", True, 3.0, "q", True, 1), (1, "new", "n", "#000000", True, 3.0, "q", True, 1))
    assert {r.action for r in annots.comment_actions(notes, same, pages).collect()} == {"keep"}


def test_links_add_then_remove(spark):
    schema = "doc_id int, page int, ord int, uri string, dest_page int"
    links = rows(spark, schema, (1, 1, 0, "http://a", None))
    more = annots.add_links(links, rows(spark, schema, (1, 1, 1, "http://b", 4), (1, 1, 2, None, None)))
    assert sorted((r.uri, r.dest_page) for r in more.collect()) == [("http://a", None), ("http://b", None)]
    assert sorted(annots.remove_link(more, rows(spark, "doc_id int, page int, index int", (1, 1, 1))).collect()) == links.collect()


def test_forms(spark):
    fields = rows(spark, "doc_id int, name string, value string, flags int", (1, "full_name", "", 2), (1, "other", "keep", 0))
    updates = rows(spark, "doc_id int, ord int, name string, value string", (1, 0, "full_name", "Jane Doe"), (1, 1, "full_name", "late"))
    assert {r.name: (r.value, r.flags) for r in forms.fill(fields, updates, True).collect()} == {"full_name": ("Jane Doe", 3), "other": ("keep", 1)}
    table = rows(spark, "doc_id int, ord int, name string, value string", (1, 0, "a", "a & b <c> \"d\" 'e'"), (1, 1, "x.y", "&amp;"))
    assert sorted(forms.from_xfdf(forms.to_xfdf(table)).select("name", "value").collect()) == sorted(table.select("name", "value").collect())
    nodes = rows(spark, "doc_id int, id int, parent int, ord int, part string, field_type string, value string", (1, 1, None, 0, "form", "Tx", None), (1, 2, 1, 0, "a", None, "v"), (1, 3, 1, 1, "b", "Btn", None))
    assert {tuple(r)[2:] for r in forms.field_rows(nodes).collect()} == {("form.a", "Tx", "v"), ("form.b", "Btn", None)}
    rights = value(spark, forms.permissions(F.lit(0).cast("long"), F.lit(3), F.lit(False)))
    assert all(rights)


def test_geometry(spark):
    one = lambda c: tuple(value(spark, c))
    lit = lambda *xs: [F.lit(float(x)) for x in xs]
    assert one(geometry.page_rect(*lit(0, 0, 1, 1, 100, 200))) == (0, 0, 100, 200)
    assert one(geometry.page_rect(*lit(0, 0, 1, 0.5, 100, 200))) == (0, 100, 100, 200)
    assert value(spark, geometry.color_hex(*lit(1, 0.5, 2))) == "#ff80ff"
    assert one(geometry.hex_color(F.lit("zz0080"), 136)) == pytest.approx((136 / 255, 0, 128 / 255))
    size = lambda *a, **k: one(geometry.target_size(F.lit(a[0]), F.lit(a[1]), *lit(a[2], a[3]), **k))
    assert size(1500, 1500, 72, 72) == (150, 150)
    assert size(200, 200, 72, 72) == (200, 200)
    assert size(6000, 3000, 0, 0) == (3000, 1500)
    points = rows(spark, "s int, ord int, x double, y double, tool string", *[(1, i, i / 10, 0.5, "pen") for i in range(8)], *[(2, i, i / 10, 0.5, "bezier") for i in range(4)], (3, 0, 0.0, 0.0, "pen"))
    left = geometry.erase(points, ["s"], 0.3, 0.5, 5.0, 100.0, 100.0).orderBy("s", "ord").collect()
    assert [(r.s, r.fragment, r.ord) for r in left] == [(1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 2, 4), (1, 2, 5), (1, 2, 6), (1, 2, 7), (3, 1, 0)]
    assert geometry.curve_segments(points, ["s"]).groupBy("s").count().orderBy("s").collect() == [(1, 7), (2, 3)]


def test_outline(spark):
    heights = rows(spark, "doc_id int, height double", *[(1, h) for h in (1.0, 2.0, 3.0, 4.0)])
    assert outline.upper_median(heights, ["doc_id"], "height").first().median == 3.0
    assert value(spark, outline.tiers(F.array(*[F.lit(h) for h in (12.0, 20.0, 19.6, 15.0, 14.9, 10.0, 8.0)]))) == [20.0, 15.0, 12.0]
    lines = [(1, 1, i, t, h) for i, (t, h) in enumerate([("second", 16.0), ("third", 14.0), ("First", 20.0), ("third again", 14.0), ("sub", 16.0), ("subsub", 14.0), *[("body text", 10.0)] * 9, ("x", 30.0)])]
    found = outline.headings(rows(spark, "doc_id int, page int, ord int, text string, height double", *lines))
    nested = outline.nest(found).orderBy("n").collect()
    assert [(r.title, r.depth, r.parent_n) for r in nested] == [("second", 0, None), ("third", 1, 1), ("First", 0, None), ("third again", 1, 3), ("sub", 1, 3), ("subsub", 2, 5)]
    nodes = rows(spark, "d int, id int, parent int, ord int", (1, 1, None, 0), (1, 2, 1, 0), (1, 3, 1, 1), (1, 4, None, 1))
    wired = {r.id: (r.prev, r.next, r.first_child, r.last_child, r.n_children) for r in outline.wire_siblings(nodes, ["d"]).collect()}
    assert wired == {1: (None, 4, 2, 3, 2), 2: (None, 3, None, None, 0), 3: (2, None, None, None, 0), 4: (1, None, None, None, 0)}


def test_scalars(spark):
    v = lambda c: value(spark, c)
    millis = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1000)
    assert v(scalar.parse_pdf_date(F.lit("D:20240229120000Z"))) == millis(2024, 2, 29, 12)
    assert v(scalar.parse_pdf_date(F.lit("20230231"))) == millis(2023, 3, 3)
    assert v(scalar.parse_pdf_date(F.lit("D:202"))) is None
    assert v(scalar.pdf_date(F.lit(-1))) == "D:19691231235959Z"
    assert v(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), 18262), "yyyy-MM-dd")) == "2020-01-01"
    assert [v(scalar.human_bytes(F.lit(n))) for n in (5, 2048, 5 << 20, 3 << 30)] == ["5 B", "2.0 KB", "5.0 MB", "3.00 GB"]
    assert [v(scalar.fuzzy_score(F.lit(t), "ab")) for t in ("AB", "abc", "xab", "a-b", "ba")] == [1000, 500, 200, 50, 0]
    assert v(scalar.error_kind(F.lit("Wrong PASSWORD, file corrupt"))) == "password"
    assert v(scalar.error_text(F.lit("Error: " + "x" * 300))) == "x" * 280 + "…"
    assert v(scalar.with_suffix(F.lit("/a.b/c.pdf"), "_x")) == "/a.b/c_x.pdf"
    assert v(annots.csv_field(F.lit('a"b'))) == '"a""b"' and v(annots.csv_field(F.lit("ab"))) == "ab"
    assert v(scalar.literal_text(F.lit("é(a)\\"))) == "\\(a\\)\\\\"
    assert [round(v(scalar.snap_zoom(F.lit(z))), 6) for z in (0.1, 1.23, 9.0)] == [0.25, 1.2, 3.0]
    assert v(scalar.wheel_zoom(F.lit(1.0), F.lit(-200.0), F.lit(1.25))) == 1.25


def test_nested_xfdf_names(spark):
    nested = """<?xml version="1.0"?><xfdf><!-- <field name="no"> --><fields>
      <field name="a"><field name="b"><value>v &lt; 1</value></field><field name="c"><value>two</value></field><field name="none"/></field>
      <field name="d"><value></value></field><field name="e"><value>é
line</value></field></fields></xfdf>"""
    rows = forms.from_xfdf(spark.createDataFrame([(1, nested), (2, ""), (3, None)], "doc_id long, xfdf string")).collect()
    assert [(r.doc_id, r.ord, r.name, r.value) for r in sorted(rows, key=lambda r: r.ord)] == [(1, 0, "a.b", "v < 1"), (1, 1, "a.c", "two"), (1, 2, "d", ""), (1, 3, "e", "é\nline")]


def test_roomiest_ties_go_to_the_first_by_name(spark):
    rows = [("u", "sdb", 5, 1), ("u", "sda", 5, 2), ("u", "sdc", 4, 9)]
    for order in (rows, rows[::-1]):
        got = documents.roomiest(spark.createDataFrame(order, "owner string, disk string, total long, available long"), ["owner"]).first()
        assert (got.disk, got.total, got.used) == ("sda", 5, 3)


def test_sums_before_a_row(spark):
    rows = [("a", i, i % 4) for i in range(50)] + [(None, i, 2) for i in range(5)] + [("b", 1, 7)]
    got = sum_before(spark.createDataFrame(rows, "g string, i int, v long").repartition(5), ["g"], ["i"], F.col("v"), "before").collect()
    assert sorted(map(tuple, got), key=str) == sorted(((g, i, v, sum(w for h, j, w in rows if h == g and j < i)) for g, i, v in rows), key=str)


def test_fnv_and_swatch_units(spark):
    text = "aé😀"
    row = spark.createDataFrame([(text,)], "t string").select(scalar.fnv1a_64(F.col("t")).alias("k"), scalar.fnv1a_64(F.lit("")).alias("none"), scalar.swatch(F.col("t")).alias("s")).first()
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    u = 0
    units = text.encode("utf-16-be")
    for at in range(0, len(units), 2):
        u = (u * 31 + int.from_bytes(units[at : at + 2], "big") + (1 << 31)) % (1 << 32) - (1 << 31)
    assert (row.k, row.none, row.s) == (f"{h:016x}", f"{0xCBF29CE484222325:016x}", abs(u) % 10)


def test_template_lines_are_as_many_as_counted(spark):
    kinds = spark.createDataFrame([(k, w, h) for k in ("ruled", "grid", "dotted", "blank") for w, h in ((595.0, 842.0), (15.0, 15.0), (40.0, 61.0))], "kind string, w double, h double")
    rows = kinds.select("kind", geometry.template_marks(F.col("kind"), F.col("w"), F.col("h")).alias("n"), F.size(geometry.template_lines(F.col("kind"), F.col("w"), F.col("h"))).alias("m")).collect()
    assert all(r.n == r.m for r in rows) and any(r.n > 100 for r in rows)


def test_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace as N

    context = N(getConf=lambda: N(get=lambda k: None), master="spark://x", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False))))
    with pytest.raises(ValueError):
        storage.shared_folder(N(sparkContext=context))
