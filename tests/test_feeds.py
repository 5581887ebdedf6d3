"""Streams give what the batch operators give; file sources and sinks."""

from __future__ import annotations

import importlib.util
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from pageloom.operators import state, text
from pageloom.sources import files
from pageloom.streaming import feeds

LOG = "k string, v int, ts timestamp"


def log(spark, n=60):
    return spark.range(n).select(F.concat(F.lit("k"), F.col("id") % 7).alias("k"), F.col("id").cast("int").alias("v"), F.timestamp_seconds((F.col("id") * 37) % 61).alias("ts"))


def stream_of(spark, tmp_path, rows, parts=3):
    folder = str(tmp_path / "in")
    rows.repartition(parts).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_latest_values(spark, tmp_path):
    rows = log(spark)
    stream = feeds.latest_values(stream_of(spark, tmp_path, rows), ["k"], "v", "ts")
    got = feeds.run_available(stream, "latest", str(tmp_path / "cp"), "complete")
    want = state.upsert_latest(rows, ["k"], ["v", "ts"], ["ts"])
    assert sorted(got.collect()) == sorted(want.select("k", "v", "ts").collect())


def test_merge_batches(spark, tmp_path):
    rows = log(spark)
    stream = stream_of(spark, tmp_path, rows)
    query = feeds.merge_batches(stream, str(tmp_path / "t"), ["k"], ["v"], ["ts"], str(tmp_path / "cp"))
    query.awaitTermination()
    got = feeds.merged_table(spark, str(tmp_path / "t"), ["k"], ["v"], ["ts"])
    want = sorted(state.upsert_latest(rows, ["k"], ["v"], ["ts"]).collect())
    assert sorted(got.select("k", "v").collect()) == want
    feeds.compact(spark, str(tmp_path / "t"), str(tmp_path / "u"), ["k"], ["v"], ["ts"])
    assert sorted(feeds.merged_table(spark, str(tmp_path / "u"), ["k"], ["v"], ["ts"]).select("k", "v").collect()) == want


def test_merge_of_more_batches_than_progress_is_kept_of(spark, tmp_path):
    rows = [(f"k{i % 3}", i) for i in range(120)]
    (tmp_path / "in").mkdir()
    for k, v in rows:
        (tmp_path / "in" / f"{v:03d}.csv").write_text(f"{k},{v},2024-01-01 00:{v // 60:02d}:{v % 60:02d}\n")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).csv(str(tmp_path / "in"))
    feeds.merge_batches(stream, str(tmp_path / "t"), ["k"], ["v"], ["ts"], str(tmp_path / "cp")).awaitTermination()
    got = feeds.merged_table(spark, str(tmp_path / "t"), ["k"], ["v"], ["ts"])
    assert sorted((r.k, r.v) for r in got.collect()) == [("k0", 117), ("k1", 118), ("k2", 119)]


def test_marker_feed_deletes_what_it_has_read(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for n in range(3):
        (tmp_path / "m" / f"{n}").write_text(f"tree\tc{n}\tn{n}\n")
    feed = feeds.marker_feed(spark, str(tmp_path / "m"))
    got = feeds.run_available(feed, "marks", str(tmp_path / "cp"))
    assert {r.value for r in got.collect()} == {f"tree\tc{n}\tn{n}" for n in range(3)}


def test_folder_feed_and_scan(spark, tmp_path):
    for name, body in (("a/x.pdf", b"%PDF-1.7 /Encrypt"), ("a/b/Y.PDF", b"%PDF-1.4"), ("z.txt", b"no")):
        (tmp_path / "d" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "d" / name).write_bytes(body)
    folder = str(tmp_path / "d")
    want = {("x.pdf", 17), ("Y.PDF", 8)}
    assert {(r.name, r.length) for r in files.scan_folder(spark, folder).collect()} == want
    feed = feeds.run_available(feeds.folder_feed(spark, folder), "feed", str(tmp_path / "cp"))
    assert {(r.name, r.length) for r in feed.collect()} == want
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    assert {r.path.rsplit("/", 1)[1]: r.reason for r in files.readable(raw).collect()} == {"x.pdf": "encrypted", "Y.PDF": None, "z.txt": "invalid"}
    plan = files.scan_folder(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_quiet_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("a", 10), ("b", 0)], "k string, s int").select("k", F.timestamp_seconds("s").alias("ts"))
    got = feeds.quiet_sessions(rows, ["k"], "ts", "5 seconds", "1 minute")
    assert sorted((r.k, r.events) for r in got.collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_marker_and_crash_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "one").write_text("tree1\tc1\tn1\ntree1\tc2\tn2\textra\nbad line\ntree2\tc3\tn3\n")
    row = files.markers(spark, str(tmp_path / "m")).first()
    assert row.tree == "tree1" and [c.name for c in row.children] == ["n1", "n2\textra", "n3"]
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.log").write_bytes("aé".encode() * 3)
    got = files.crash_logs(spark, str(tmp_path / "c"), 5).first()
    assert (got.name, got.length, got.preview) == ("x.log", 9, "aéa")


def test_csv_and_xfdf(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Text", None, 'a "b", c', 0.1, 0.2, 0.3, 0.4)], "page int, subtype string, color string, contents string, x0 double, y0 double, x1 double, y1 double")
    files.write_annotations_csv(rows.coalesce(1), str(tmp_path / "csv"))
    lines = "".join(p.read_text() for p in Path(tmp_path / "csv").glob("part-*")).splitlines()
    assert lines == ["page,type,color,contents,x0,y0,x1,y1", '1,Text,,"a ""b"", c",0.1000,0.2000,0.3000,0.4000']
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "7.xfdf").write_text('<xfdf><fields><field name="a"><value>x &amp; y</value></field></fields></xfdf>')
    fields = spark.createDataFrame([(7, "a", "", 0)], "doc_id long, name string, value string, flags int")
    assert files.import_xfdf(spark, str(tmp_path / "x"), fields).first().value == "x & y"


def test_text_files_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\nb"), (2, ""), (3, None), (4, "é\n\n")], "doc_id long, text string")
    files.write_text(docs, str(tmp_path / "t"))
    assert sorted(files.read_text(spark, str(tmp_path / "t")).collect()) == sorted(text.export_text(docs).collect())


def test_text_files_are_few(spark, tmp_path):
    """As many files as tasks, whatever the number of documents; lines like heads, of any document, come back."""
    odd = ["=== Document 5 ===\nx", "a\n=== Document 5 ===\n==== Document 6 ===", "\n\n=== Document", "=== Document ", "\r\n\x1e a ===\n", " ===\n", "x\n=", "==", "\u00e9\U0001f600\n=====  Document 1 ==="]
    docs = spark.createDataFrame([(i - 3, odd[i % len(odd)]) for i in range(300)], "doc_id long, text string").repartition(3)
    files.write_text(docs, str(tmp_path / "t"))
    assert len(list((tmp_path / "t").rglob("*.txt"))) <= 3
    assert sorted(files.read_text(spark, str(tmp_path / "t")).collect()) == sorted(text.export_text(docs).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61")  # heads on the edges of splits
    try:
        assert sorted(files.read_text(spark, str(tmp_path / "t")).collect()) == sorted(text.export_text(docs).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_library_stands_without_the_llm_folders(tmp_path):
    """A copy of the library without them still imports, lists its queries and has their SQL."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("pageloom.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone()); sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
assert "search_pages" in e.queries() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) == set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
    assert importlib.util.find_spec("pageloom.plans.catalogue")
