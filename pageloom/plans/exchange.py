"""Queries on files written and read again, and on small pieces of documents, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import scalar
from pageloom.operators import annots, documents, forms, geometry, labels, text
from pageloom.plans.text import ORACLES as TEXT_ORACLES
from pageloom.sources import files
from pageloom.sources.tables import table
from pageloom.storage import shared_folder


def folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents exported as text files and read again."""
    path = folder(spark)
    files.write_text(table(spark, sf_dir, "documents"), path)
    return files.read_text(spark, path)


def marker_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A marker file for each region, with a line for each nation."""
    rows = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat_ws("\t", "r_name", F.col("n_nationkey").cast("string"), "n_name")
    path = folder(spark)
    rows.select("r_regionkey", line.alias("value")).repartition("r_regionkey").write.partitionBy("r_regionkey").text(path)
    return files.markers(spark, path).select("tree", F.inline("children"))


def readable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: some without a head, some with an encryption dictionary in the trailer."""
    n = F.col("doc_id") % 5
    head, tail = F.when(n == 1, "plain ").otherwise("%PDF-1.7 "), F.when(n == 2, " trailer << /Encrypt 9 0 R >>").otherwise(" trailer << >>")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.col("text"), tail).cast("binary").alias("content"))
    return files.readable(rows).select("doc_id", "reason")


def known_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files, and what is known of those in nations of one region."""
    found = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), F.col("s_nationkey").alias("nation"))
    info = table(spark, sf_dir, "supplier").filter("s_nationkey % 5 = 0").select(F.col("s_name").alias("path"), F.col("s_acctbal").alias("balance"))
    return files.ingest(found, info)


def comments_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as comments on five pages, by page and height."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("id"), (F.col("event_id") % 5).alias("page_index"), F.floor("value").alias("y"))
    return annots.in_page_order(rows)


def field_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the widgets of a document that is flattened."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 8).cast("int")).alias("flags"))
    return forms.flattened(rows)


def stamped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as pages, of which the second to fourth are stamped with today's date."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).distinct()
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("filename"))
    return labels.stamped_pages(labels.header_footer(pages, names, "{filename} {date} {page}/{total}", labels.today(), 2, 4), names)


def dated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second to fourth pages of each order with the text of their stamp, today's date in it."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).distinct()
    names = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("filename"))
    return labels.header_footer(pages, names, "{filename} {date} {page}/{total}", labels.today(), 2, 4)


def template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as blank pages of four kinds: every mark."""
    kind = F.get(F.array(*[F.lit(k) for k in ("ruled", "grid", "dotted", "blank")]), (F.col("p_partkey") % 4).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(geometry.template_lines(kind, F.col("p_size") * 4.0, F.col("p_size") * 6.0)).alias("mark", "at"))
    return rows.select("p_partkey", "mark", *[F.round(F.col(f"at.{c}"), 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


def preset_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each compression level makes of the suppliers' pictures; the table of levels has three rows."""
    levels = F.broadcast(geometry.presets(spark))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 6).alias("level"))
    return rows.join(levels, "level").select("s_suppkey", "name", "quality", "dpi", "threshold", "longest", "strip_metadata", "zlib")


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as characters of lines of a page a user, the value as their place."""
    value = F.floor("value")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(1).alias("page"), (F.col("event_id") % 4).alias("line"), F.col("event_id").alias("pos"), F.substring("event_type", 1, 1).alias("c"), value.alias("x0"), (value % 9).alias("y0"), (value + 6).alias("x1"), (value % 9 + 12).alias("y1"))
    return text.line_boxes(rows)


def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as base64, every other one as a data URL, and back."""
    body = F.base64(F.col("text").cast("binary"))
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:text/plain;base64,"), body)).otherwise(body)
    return table(spark, sf_dir, "documents").select("doc_id", documents.from_data_url(url).cast("string").alias("text"))


def path_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stable key of each customer's name."""
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.fnv1a_64(F.col("c_name")).alias("key"))


QUERIES = {f.__name__: f for f in (text_files, marker_files, readable_files, known_files, comments_in_order, field_flags, stamped_pages, dated_pages, template_lines, preset_targets, line_boxes, data_urls, path_keys)}

ORACLES = {
    "text_files": TEXT_ORACLES["export_text"],
    "marker_files": "SELECT r_name AS tree, CAST(n_nationkey AS VARCHAR) AS child, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "readable_files": "SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'invalid' WHEN doc_id % 5 = 2 THEN 'encrypted' END AS reason FROM documents",
    "known_files": "SELECT s_name AS path, s_nationkey AS nation, CASE WHEN s_nationkey % 5 = 0 THEN s_acctbal END AS balance FROM supplier",
    "comments_in_order": "SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id % 5, floor(value), event_id) AS INTEGER) AS place, event_id AS id FROM events",
    "field_flags": "SELECT user_id AS doc_id, event_id AS ord, CAST(CASE WHEN event_id % 3 <> 0 THEN event_id % 8 ELSE 0 END | 1 AS INTEGER) AS flags FROM events",
    "stamped_pages": """SELECT o_orderkey AS doc_id, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber BETWEEN 2 AND 4) AS stamped
      FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "dated_pages": """WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS page FROM lineitem), t AS (SELECT doc_id, count(*) AS total FROM p GROUP BY doc_id)
      SELECT doc_id, page, o_orderpriority || ' ' || strftime(timezone('UTC', now()), '%Y-%m-%d') || ' ' || page || '/' || total AS text
      FROM p JOIN t USING (doc_id) JOIN orders ON o_orderkey = doc_id WHERE page BETWEEN 2 AND 4""",
    "template_lines": """WITH p AS (SELECT p_partkey, ['ruled', 'grid', 'dotted', 'blank'][p_partkey % 4 + 1] AS kind, p_size * 4.0::DOUBLE AS w, p_size * 6.0::DOUBLE AS h FROM part),
      m AS (SELECT p_partkey, 25.0 AS x0, y AS y0, w - 25 AS x1, y AS y1, -y AS o1, 0.0 AS o2 FROM (SELECT *, h - 30 - 20.0 * unnest(range(0, 100)) AS y FROM p WHERE kind = 'ruled') WHERE y > 20
        UNION ALL SELECT p_partkey, 0, y, w, y, -y, 0 FROM (SELECT *, h - 20 - 20.0 * unnest(range(0, 100)) AS y FROM p WHERE kind = 'grid') WHERE y > 0
        UNION ALL SELECT p_partkey, x, 0, x, h, 1e6, x FROM (SELECT *, 20.0 + 20.0 * unnest(range(0, 100)) AS x FROM p WHERE kind = 'grid') WHERE x < w
        UNION ALL SELECT p_partkey, x - 0.8, y - 0.8, x + 0.8, y + 0.8, -y, x FROM (SELECT *, 20.0 + 20.0 * unnest(range(0, 100)) AS x FROM (
          SELECT *, h - 20 - 20.0 * unnest(range(0, 100)) AS y FROM p WHERE kind = 'dotted') WHERE y > 10) WHERE x < w - 10)
      SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY o1, o2) - 1 AS INTEGER) AS mark, round(CAST(x0 AS DOUBLE), 6) AS x0, round(CAST(y0 AS DOUBLE), 6) AS y0, round(CAST(x1 AS DOUBLE), 6) AS x1, round(CAST(y1 AS DOUBLE), 6) AS y1 FROM m""",
    "preset_targets": """SELECT s_suppkey, name, quality, dpi, threshold, longest, strip_metadata, zlib FROM supplier JOIN (VALUES (0, 'lossless', 0, NULL, 1.5::DOUBLE, NULL, false, 6),
      (1, 'book', 78, 150, 1.5, 3000, true, 6), (2, 'screen', 65, 72, 1.5, 2000, true, 6)) v(level, name, quality, dpi, threshold, longest, strip_metadata, zlib) ON s_suppkey % 6 = level""",
    "line_boxes": """SELECT user_id AS doc_id, 1 AS page, event_id % 4 AS line, string_agg(event_type[1], '' ORDER BY event_id) AS text, CAST(min(floor(value)) AS BIGINT) AS x0,
      CAST(min(floor(value) % 9) AS BIGINT) AS y0, CAST(max(floor(value) + 6) AS BIGINT) AS x1, CAST(max(floor(value) % 9 + 12) AS BIGINT) AS y1 FROM events GROUP BY user_id, event_id % 4""",
    "data_urls": "SELECT doc_id, text FROM documents",
    "path_keys": """SELECT c_custkey, lower(lpad(to_hex(CAST(h AS UBIGINT)), 16, '0')) AS key FROM (SELECT c_custkey, list_reduce(list_prepend(14695981039346656037::UHUGEINT,
      list_transform(string_split(c_name, ''), lambda c: ascii(c)::UHUGEINT)), lambda h, c: (xor(h, c) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM customer)""",
}
