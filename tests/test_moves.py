"""Logs of moves, joined from ranges, against playing them one by one."""

from __future__ import annotations

import random

import pytest

from pageloom.operators import moves

LOG = "doc int, seq int, source int, target int"


@pytest.mark.parametrize("parts", ["3", "29"])
def test_logs_in_ranges(spark, parts):
    draw = random.Random(int(parts))
    sizes = {1: 9, 2: 1, 3: 0, 4: 5, 6: 40}
    log = [(d, s, draw.choice([draw.randrange(-1, 10), draw.randrange(-1, 40)]), draw.choice([None, *range(-1, 40)])) for d, n in ((1, 700), (2, 3), (3, 2), (5, 4), (6, 900)) for s in range(n)]
    draw.shuffle(log)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = moves.played(spark.createDataFrame(log, LOG).repartition(3), spark.createDataFrame(list(sizes.items()), "doc int, n int"), ["doc"], ["seq"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for doc, n in sizes.items():
        want = list(range(n))
        for _, _, source, target in sorted((r for r in log if r[0] == doc), key=lambda r: r[1]):
            if source is not None and target is not None:
                moves.play(want, source, target)
        assert [r.item for r in sorted((r for r in got if r.doc == doc), key=lambda r: r.place)] == want
    assert {r.doc for r in got} == {1, 2, 4, 6}


def test_active_tab_follows(spark):
    """As the rule has it: it goes where it is moved, one down if a tab leaves before it, one up if one comes before it."""
    draw = random.Random(2)
    log, active = [(1, s, draw.randrange(6), draw.randrange(6)) for s in range(40)], 2
    for _, _, source, target in log:
        if active == source:
            active = target
        elif source < active <= target:
            active -= 1
        elif target <= active < source:
            active += 1
    tabs = spark.createDataFrame([(d, i, f"{d}-{i}") for d in (1, 2) for i in range(6)], "doc int, place int, tab string")
    out = moves.final_order(tabs, spark.createDataFrame(log, LOG), spark.createDataFrame([(1, 2)], "doc int, place int"), ["doc"], ["seq"], "tab").collect()
    assert [(r.place, r.tab) for r in out if r.active] == [(active, "1-2")] and len(out) == 12
    assert [r.tab for r in sorted(out, key=lambda r: r.place) if r.doc == 2] == [f"2-{i}" for i in range(6)]
