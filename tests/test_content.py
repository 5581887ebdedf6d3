"""Content operators against a plain stack machine."""

from __future__ import annotations

import math
import random

import pytest

from pageloom.operators import content

OPS = "doc int, content string, ord int, op string, numbers array<double>, name string"
OBJECTS = "doc int, id string, kind string, matrix array<double>, mask string"


def machine(ops):
    """(ord, name, matrix) of the drawings of one content, step by step."""
    stack, now, out = [], content.UNIT, []
    for _, _, at, op, numbers, name in sorted(ops, key=lambda r: r[2]):
        if op == "q":
            stack.append(now)
        elif op == "Q" and stack:
            now = stack.pop()
        elif op == "cm" and numbers and len(numbers) >= 6:
            now = content.times(tuple(numbers[-6:-2]), now)
        elif op == "Do" and name is not None:
            out.append((at, name, now))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_long_contents_in_ranges(spark, seed):
    """Brackets open and close across ranges, more close than open, and scopes stay open."""
    draw = random.Random(seed)
    ops = []
    for doc, size in ((1, 900), (1, 3), (2, 400), (None, 50)):
        for i in range(size):
            op = draw.choice(["q", "Q", "Q", "cm", "Do", "BT"] if seed else ["q", "q", "Q", "cm", "Do"])
            numbers = [9.0] * draw.randrange(2) + [draw.choice([0.5, 1.0, 2.0, -1.0, 0.0]) for _ in range(draw.choice([6, 6, 5]))] if op == "cm" else None
            ops.append((doc, f"c{size}", i, op, numbers, f"n{i}" if i % 9 else None))
    draw.shuffle(ops)
    table = spark.createDataFrame(ops, OPS).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    got = {(r.doc, r.content, r.ord): (r.name, (r.a, r.b, r.c, r.d)) for r in content.drawings(table, ["doc", "content"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {}
    for key in {r[:2] for r in ops}:
        want |= {(*key, at): (name, m) for at, name, m in machine([r for r in ops if r[:2] == key])}
    assert got == want


def test_stretches_compose(spark):
    """A stretch applied to a stack is what its operators do to it one by one, whatever the stack."""
    draw = random.Random(1)
    for _ in range(300):
        ops = [(draw.choice("qQQm"), tuple(draw.choice([0.5, 2.0, 0.0, 1.0]) for _ in range(4))) for _ in range(draw.randrange(12))]
        stack, now = [tuple(map(float, (i, 1, 0, i))) for i in range(draw.randrange(4))], (1.0, 2.0, 0.0, 1.0)
        stretch = content.Stretch()
        for op, m in ops:
            stretch.step("cm" if op == "m" else op, m)
        got = stretch.after(list(stack), now)
        for op, m in ops:
            if op == "q":
                stack.append(now)
            elif op == "Q" and stack:
                now = stack.pop()
            elif op == "m":
                now = content.times(m, now)
        assert got == (stack, now)


def test_nested_forms(spark):
    """Forms in forms with matrices, one inside itself, a soft mask, names that stand for nothing, and the level limit."""
    half = [0.5, 0.0, 0.0, 0.5, 0.0, 0.0]
    ops = [
        (1, "page", 1, "q", None, None), (1, "page", 2, "cm", [100.0, 0.0, 0.0, 50.0, 7.0, 7.0], None), (1, "page", 3, "Do", None, "Im"), (1, "page", 4, "Q", None, None),
        (1, "page", 5, "cm", [0.0, 8.0, -4.0, 0.0, 0.0, 0.0], None), (1, "page", 6, "Do", None, "Fm"), (1, "page", 7, "Do", None, "Nothing"),
        (1, "form", 1, "Do", None, "Im"), (1, "form", 2, "Do", None, "Self"), (1, "form", 3, "cm", half, None), (1, "form", 4, "Do", None, "Small"),
        (2, "page", 1, "Do", None, "Im"),
    ]
    names = [(1, "page", "Im", "a"), (1, "page", "Fm", "form"), (1, "page", "Nothing", "gone"), (1, "form", "Im", "a"), (1, "form", "Self", "form"), (1, "form", "Small", "b")]
    objects = [(1, "a", "Image", None, "soft"), (1, "b", "Image", None, None), (1, "form", "Form", [3.0, 0.0, 0.0, 3.0, 1.0, 1.0], None), (1, "font", "Font", None, None)]
    chain = 14
    for i in range(chain):
        ops += [(3, f"f{i}", 1, "cm", [2.0, 0.0, 0.0, 2.0, 0.0, 0.0], None), (3, f"f{i}", 2, "Do", None, "next"), (3, f"f{i}", 3, "Do", None, "pic")]
        names += [(3, f"f{i}", "next", f"f{i + 1}"), (3, f"f{i}", "pic", f"p{i}")]
        objects += [(3, f"f{i}", "Form", [1.0] if i else None, None), (3, f"p{i}", "Image", None, None)]
    tables = spark.createDataFrame(ops, OPS), spark.createDataFrame(names, "doc int, content string, name string, target string"), spark.createDataFrame(objects, OBJECTS)
    pages = spark.createDataFrame([(1, "page"), (2, "page"), (3, "f0"), (3, "f0")], "doc int, content string")
    got = {(r.doc, r.image): (r.w, r.h) for r in content.placements(*tables, pages).collect()}
    want = {(1, "a"): (100.0, 50.0), (1, "soft"): (100.0, 50.0), (1, "b"): (12.0, 6.0)}
    assert got == want | {(3, f"p{i}"): (2.0 ** (i + 1), 2.0 ** (i + 1)) for i in range(content.MOST_LEVELS)}
    assert content.placements(tables[0].limit(0), *tables[1:], pages).count() == 0
    assert content.placements(*tables, pages.limit(0)).count() == 0
    assert math.isclose(got[1, "b"][0], math.hypot(0.0, 8 * 3 / 2))


@pytest.mark.parametrize("rows", (1, 7, 10_000))
def test_contents_in_batches(spark, rows):
    """Short contents, done at once, beside one of many batches and one that nests deeper than the rounds go."""
    draw = random.Random(rows)
    ops = []
    for doc in range(60):
        for i in range(draw.choice([1, 2, 9, 25])):
            op = draw.choice(["q", "Q", "Q", "cm", "cm", "Do", "Do"])
            ops.append((doc, f"c{doc % 7}", i, op, [draw.choice([0.5, 2.0, -1.0, 0.0]) for _ in range(6)] if op == "cm" else None, f"n{i}"))
    ops += [(60, "long", i, "Do" if i % 3 else draw.choice(["q", "Q"]), None, f"n{i}") for i in range(300)]
    ops += [(doc, "deep", i, "cm" if i % 2 else "Do", [-1.0, 0.0, 0.0, 1.0, 0.0, 0.0], f"n{i}") for doc in range(61, 66) for i in range(2 * content.MOST_ROUNDS + 40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    got = {(r.doc, r.content, r.ord): (r.name, (r.a, r.b, r.c, r.d)) for r in content.drawings(spark.createDataFrame(ops, OPS), ["doc", "content"]).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for key in {r[:2] for r in ops}:
        want |= {(*key, at): (name, m) for at, name, m in machine([r for r in ops if r[:2] == key])}
    assert got == want


def test_rounds_read_forms_alone(spark, monkeypatch):
    """Images are met once, after the rounds: what is written for the rounds is a row for each form."""
    counts, kept = [], content.checkpointed

    def counted(df):
        df = kept(df)
        counts.append(df.count())
        return df

    monkeypatch.setattr(content, "checkpointed", counted)
    ops, names, objects, deep, wide = [], [], [], 5, 40
    for i in range(deep):
        for j in range(wide):
            ops.append((1, f"f{i}", j, "Do", None, f"n{j}"))
            names.append((1, f"f{i}", f"n{j}", f"p{i}-{j}" if j else f"f{i + 1}"))
            objects.append((1, f"p{i}-{j}", "Image", None, None))
        objects.append((1, f"f{i}", "Form", None, None))
    tables = spark.createDataFrame(ops, OPS), spark.createDataFrame(names, "doc int, content string, name string, target string"), spark.createDataFrame(objects, OBJECTS)
    assert content.placements(*tables, spark.createDataFrame([(1, "f0")], "doc int, content string")).count() == deep * (wide - 1)
    assert sum(counts) <= deep * wide + 3 * deep
