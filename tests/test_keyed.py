"""A table that is merged into: what readers see before, during and after merges, and comments saved into it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pageloom.operators import annots
from pageloom.sources.keyed import KeyedTable

CHANGES = "doc int, id string, v string, action string"


def contents(table, version=None):
    rows = table.read(version).collect()
    assert len({(r.doc, r.id) for r in rows}) == len(rows)
    return {(r.doc, r.id): r.v for r in rows}


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 7).cast("int").alias("doc"), F.col("id").cast("string").alias("id"), F.lit("old").alias("v"))
    return KeyedTable.create(rows, str(tmp_path / "t"), ["doc", "id"], 16)


def test_merges(spark, table):
    before = contents(table)
    assert len(before) == 200
    files = table._manifest()["files"]
    changes = [(1, "1", "new", "put"), (9, "x", "added", "put"), (2, "2", None, "delete"), (3, "no", None, "delete"), (4, "4", "never", "keep")]
    assert table.merge(spark.createDataFrame(changes, CHANGES)) == 2
    want = {k: v for k, v in before.items() if k != (2, "2")} | {(1, "1"): "new", (9, "x"): "added"}
    assert contents(table) == want and contents(table, 1) == before
    same = [b for b, folder in table._manifest()["files"].items() if files.get(b) == folder]
    assert len(same) >= len(files) - 4
    assert table.merge(spark.createDataFrame([], CHANGES)) == 2
    everything = table.read().withColumn("action", F.lit("delete"))
    assert table.merge(everything) == 3 and contents(table) == {}
    assert table.merge(spark.createDataFrame([(1, "1", None, "put")], CHANGES)) == 4 and contents(table) == {(1, "1"): None}
    assert contents(KeyedTable(spark, table.path)) == {(1, "1"): None}
    assert table.vacuum() >= 2 and contents(table) == {(1, "1"): None} and table._versions() == [4]


def test_a_merge_that_dies(spark, table, monkeypatch):
    """Its data is written and its manifest is not: nothing has happened, and the next merge goes through."""
    before = contents(table)
    change = spark.createDataFrame([(1, "1", "new", "put")], CHANGES)
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError, match="gone"):
            table.merge(change)
    assert contents(table) == before
    assert table.merge(change) == 2 and contents(table)[1, "1"] == "new"
    assert table.vacuum() == 1 and contents(table)[1, "1"] == "new"


def test_two_merges_at_once(spark, table, monkeypatch):
    """One finds its number taken; tried again it comes after the other."""
    written = KeyedTable._written

    def meanwhile(self, rows, manifest):
        out = written(self, rows, manifest)
        monkeypatch.setattr(KeyedTable, "_written", written)
        KeyedTable(spark, self.path).merge(spark.createDataFrame([(1, "1", "other", "put"), (1, "8", "other", "put")], CHANGES))
        return out

    monkeypatch.setattr(KeyedTable, "_written", meanwhile)
    mine = spark.createDataFrame([(1, "1", "mine", "put")], CHANGES)
    with pytest.raises(RuntimeError, match="version 2"):
        table.merge(mine)
    assert contents(table)[1, "1"] == "other"
    assert table.merge(mine) == 3
    assert contents(table)[1, "1"] == "mine" and contents(table)[1, "8"] == "other"


def test_tables_that_are_there_or_not(spark, table, tmp_path):
    with pytest.raises(FileExistsError):
        KeyedTable.create(table.read(), table.path, ["doc", "id"])
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, str(tmp_path / "none")).read()
    empty = KeyedTable.create(table.read().limit(0), str(tmp_path / "e"), ["doc", "id"])
    assert contents(empty) == {}


def test_comments_are_saved(spark, tmp_path):
    """Changed text, a colour of another case, one deleted, one new, one for a page that is not there."""
    notes = spark.createDataFrame([(1, "same", "t", "#AAAAAA"), (1, "text", "old", "#000000"), (1, "color", "c", None), (1, "gone", "g", "#000000"), (2, "same", "t", None)], "doc_id int, id string, text string, color string")
    comments = spark.createDataFrame([(1, "same", "t", "#aaaaaa", 1), (1, "text", "new", "#000000", 1), (1, "color", "c", "#ffffff", 1), (1, "new", None, "#111111", 1), (1, "far", "f", "#111111", 9), (2, "same", "t", "", 1)], "doc_id int, id string, text string, color string, page int")
    pages = spark.createDataFrame([(1, 1), (2, 1)], "doc_id int, page int")
    saved = KeyedTable.create(notes, str(tmp_path / "n"), ["doc_id", "id"], 4)
    saved.merge(annots.comment_changes(notes, comments, pages))
    got = {(r.doc_id, r.id): (r.text, r.color) for r in saved.read().collect()}
    assert got == {(1, "same"): ("t", "#AAAAAA"), (1, "text"): ("new", "#000000"), (1, "color"): ("c", "#ffffff"), (1, "new"): ("", "#111111"), (2, "same"): ("t", None)}
    assert annots.comment_changes(saved.read(), comments, pages).count() == 0
