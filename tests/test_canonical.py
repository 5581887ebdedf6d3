"""Canonical texts of values, and nested objects that are equal but for the order of names."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pageloom.operators import canonical

NODES = "doc int, id int, parent int, name string, pos int, kind string, value string"


def rows_of(value, doc, ids, parent=None, name=None, pos=None):
    """Rows of a Python value; dictionaries and lists are nested."""
    i = next(ids)
    kind = {dict: "dict", list: "array", bool: "bool", int: "int", float: "real", str: "string", type(None): "null"}[type(value)]
    text = None if kind in ("dict", "array", "null") else str(value).lower() if kind == "bool" else str(value)
    yield doc, i, parent, name, pos, kind, text
    if kind == "dict":
        for at, (k, v) in enumerate(value.items()):
            yield from rows_of(v, doc, ids, i, k, at)
    elif kind == "array":
        for at, v in enumerate(value):
            yield from rows_of(v, doc, ids, i, None, at)


def test_plain_texts(spark):
    cases = [
        ("null", None, "null"), ("bool", "TRUE", "true"), ("int", " 12", "12"), ("int", "-0", "0"), ("int", "x", None), ("real", "1.50", "1.5"), ("real", "100", "100"), ("real", "0.0000001", "0"), ("real", "-2.1234567", "-2.123457"),
        ("name", "A b#", "/A#20b#23"), ("name", "é!", "/#C3#A9#21"), ("name", '"', '/"'), ("name", "", "/"), ("string", "plain [x]", "(plain [x])"), ("string", "a(b", "<612862>"), ("string", "a\\", "<615C>"),
        ("string", "é", "<C3A9>"), ("string", "a\n", "<610A>"), ("string", "", "()"), ("ref", "12  0", "12 0 R"), ("dict", None, None), ("int", None, "null"),
    ]
    table = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(cases)], "i int, kind string, value string")
    got = {r.i: r.t for r in table.select("i", canonical.plain_text(F.col("kind"), F.col("value")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_names_of_every_character(spark):
    chars = [chr(c) for c in [*range(1, 0x180), 0x2028, 0x1F600]]
    names = [*chars, *[f"a{c}b" for c in chars], "plain.Name-1", ""]
    plain = set(map(chr, range(0x22, 0x7F))) - set(canonical.SPELLED)
    want = ["/" + "".join(c if c in plain else "".join(f"#{b:02X}" for b in c.encode()) for c in n) for n in names]
    table = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    got = {r.i: r.t for r in table.select("i", canonical.name_text(F.col("name")).alias("t")).collect()}
    assert [got[i] for i in range(len(names))] == want


def test_equal_structures(spark):
    draw = random.Random(3)

    def make(depth):
        kind = draw.randrange(6 if depth else 4)
        if kind == 4:
            return {draw.choice("abcd"): make(depth - 1) for _ in range(draw.randrange(3))}
        if kind == 5:
            return [make(depth - 1) for _ in range(draw.randrange(3))]
        return [draw.choice([1, 2]), draw.choice([1.0, 2.5]), draw.choice(["1", "x"]), None][kind]

    def shuffled(v):
        if isinstance(v, dict):
            items = [(k, shuffled(x)) for k, x in v.items()]
            draw.shuffle(items)
            return dict(items)
        return [shuffled(x) for x in v] if isinstance(v, list) else v

    def frozen(v):
        if isinstance(v, dict):
            return "dict", frozenset((k, frozen(x)) for k, x in v.items())
        return ("array", tuple(map(frozen, v))) if isinstance(v, list) else (isinstance(v, str), v)

    values = [make(3) for _ in range(120)]
    values += [shuffled(v) for v in values] + [{"a": {}}, {"a": []}, {"a": None}, {}, [], [[], []], [[[]]], {"0": 1}, [1]]
    ids, rows, of = iter(range(10**6)), [], {}
    for doc, v in enumerate(values):
        new = list(rows_of(v, doc % 2, ids))
        of[new[0][1]] = v
        rows += new
    rows += [(0, 900001, 900002, "x", 0, "dict", None), (0, 900002, 900001, "x", 0, "dict", None), (0, 900003, 77777777, "x", 0, "int", "1")]
    table = spark.createDataFrame(rows, NODES).repartition(5)
    least = {}
    for i, v in sorted(of.items()):
        least.setdefault(frozen(v), i)
    assert {r.id: r.canonical for r in canonical.equal_objects(table, ["doc"], []).collect()} == {i: least[frozen(v)] for i, v in of.items()}
    sizes = {r.id: r.nodes for r in canonical.digests(table, ["doc"]).collect()}
    assert all(sizes[i] == len(list(rows_of(v, 0, iter(range(1000))))) for i, v in of.items())
    assert canonical.digests(table.limit(0), ["doc"]).count() == 0


def test_a_wide_array(spark):
    """Two arrays of thirty thousand numbers, equal but for one place."""
    n = 30_000
    rows = spark.range(3).crossJoin(spark.range(n).withColumnRenamed("id", "pos")).select(((F.col("id") + 1) * 100_000 + F.col("pos")).alias("id"), F.col("id").alias("parent"), F.lit(None).cast("string").alias("name"), F.col("pos").cast("int").alias("pos"), F.lit("int").alias("kind"), F.when((F.col("id") == 2) & (F.col("pos") == 5), 0).otherwise(F.col("pos")).cast("string").alias("value"))
    tops = spark.range(3).select("id", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("pos"), F.lit("array").alias("kind"), F.lit(None).cast("string").alias("value"))
    found = {r.id: r.canonical for r in canonical.equal_objects(tops.unionByName(rows), []).collect()}
    assert found == {0: 0, 1: 0, 2: 2}


def test_plain_values_stay_out_of_the_rounds(spark, monkeypatch):
    """Tables of the rounds hold dictionaries and arrays alone; values in plain ones, in circles or without an id give nothing."""
    counts, kept = [], canonical.checkpointed

    def counting(df):
        df = kept(df)
        counts.append(df.count())
        return df

    monkeypatch.setattr(canonical, "checkpointed", counting)
    ids, rows, deep = iter(range(10**6)), [], 7
    for _ in range(3):
        deep = [deep, {"a": deep, "b": list(range(20))}] if deep == 7 else [deep]
    values = [deep, deep, [deep, 1], 7, {"a": list(range(50))}, "7"]
    for v in values:
        rows += rows_of(v, 1, ids)
    nested, tops = sum(r[5] in ("dict", "array") for r in rows), {r[1]: v for r, v in zip([r for r in rows if r[2] is None], values, strict=True)}
    plain = next(r[1] for r in rows if r[5] == "int" and r[2] is not None)
    odd = [(1, 900001, plain, "x", 0, "dict", None), (1, 900002, 900002, "x", 0, "dict", None), (1, 900003, 900002, "x", 0, "array", None), (1, None, None, "x", 0, "int", "7"), (None, 5, None, "x", 0, "int", "7"), (1, 900004, None, "x", 0, None, "7")]
    found = canonical.digests(spark.createDataFrame(rows + odd, NODES).repartition(3), ["doc"]).collect()
    assert {r.id: r.nodes for r in found} == {i: len(list(rows_of(v, 1, iter(range(1000))))) for i, v in tops.items()} | {900004: 1}
    digest = {r.id: r.digest for r in found}
    first = list(tops)
    assert digest[first[0]] == digest[first[1]] and len(set(digest.values())) == 6
    assert len(counts) <= 6 and counts[0] <= nested + 7 and sum(counts) <= 4 * nested
