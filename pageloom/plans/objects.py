"""Queries on files' revisions and on merged files as objects, made of the order tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.operators import canonical, merging, revisions
from pageloom.sources.tables import table
from pageloom.storage import checkpointed


def sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A supplier is a file, its lines are sections, the last the newest; some chains are long, run in a circle or lack a section."""
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 6").select(F.col("l_suppkey").alias("doc"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_partkey").alias("p"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("k", "l", "p")).cast("long"))
    doc, n = F.col("doc"), F.col("n")
    prev = F.when(n > 1, (n - 1) * 100).when(doc % 7 == 0, F.lit(300)).when(doc % 11 == 3, F.lit(7))
    tables = rows.select("doc", (n * 100).alias("offset"), prev.cast("long").alias("prev"), F.when(n % 3 == 0, n * 100 + 50).alias("stm"))
    third = rows.filter(n % 3 == 0)
    streams = third.filter((doc % 13 != 5) | (n != 6)).select("doc", (n * 100 + 50).alias("offset"), F.lit(None).cast("long").alias("prev"), F.lit(None).cast("long").alias("stm"))
    own = rows.select("doc", (n * 100).alias("offset"), (F.col("p") % 20).alias("num"), F.lit(0).alias("gen"), F.concat(F.lit("o"), F.col("k").cast("string")).alias("entry"))
    packed = third.select("doc", (n * 100 + 50).alias("offset"), ((F.col("p") + F.col("k")) % 20).alias("num"), F.lit(0).alias("gen"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("entry"))
    starts = rows.groupBy("doc").agg((F.max("n") * 100).alias("offset"))
    return tables.unionByName(streams), starts, own.unionByName(packed)


def revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, starts, _ = sections(spark, sf_dir)
    return revisions.chain(links, starts).sections


def revision_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, starts, _ = sections(spark, sf_dir)
    return revisions.chain(links, starts).errors


def chain_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, starts, entries = sections(spark, sf_dir)
    return revisions.newest(revisions.chain(links, starts), entries, ["num", "gen"], ["entry"])


def merged(spark: SparkSession, sf_dir: str) -> merging.Merged:
    """Orders as files of a catalogue, a page tree, perhaps an outline, and a page and a stream a line, fifty merged files in all."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = checkpointed(rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("p"), n.alias("n")))
    docs = lines.select("doc_id").distinct()

    def objects_of(rows: DataFrame, *pairs: tuple[F.Column, str]) -> DataFrame:
        return rows.select("doc_id", F.inline(F.array(*[F.struct(i.cast("long").alias("id"), F.lit(k).alias("kind")) for i, k in pairs])))

    def edges_of(rows: DataFrame, *pairs: tuple[F.Column, F.Column]) -> DataFrame:
        return rows.select("doc_id", F.inline(F.array(*[F.struct(a.cast("long").alias("src"), b.cast("long").alias("dst")) for a, b in pairs])))

    one, two, three, page, stream = F.lit(1), F.lit(2), F.lit(3), F.col("n") * 2 + 10, F.col("n") * 2 + 11
    outlined = docs.filter("doc_id % 4 = 0")
    objects = objects_of(docs, (one, "Catalog"), (two, "Pages")).unionByName(objects_of(outlined, (three, "Outlines"))).unionByName(objects_of(lines, (page, "Page"), (stream, "Stream")))
    edges = edges_of(docs, (one, two), (one, three)).unionByName(edges_of(lines, (two, page), (page, two), (page, stream), (stream, F.when(F.col("p") % 2 == 0, 3).otherwise(1))))
    order = docs.select((F.col("doc_id") % 50).alias("merged_id"), (-F.col("doc_id")).alias("ord"), "doc_id")
    return merging.merge_objects(objects, edges, order)


def merged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).objects


def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).edges


def order_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a dictionary with names in one of two orders, an array of numbers and a dictionary inside."""
    k, even = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    price, year = F.round(F.col("o_totalprice") / 100_000) / 4, F.year("o_orderdate")

    def value(n: int, parent: int | None, name: str | None, pos: F.Column | int | None, kind: str, of: F.Column | None = None) -> F.Column:
        text = lambda x, t: (F.lit(x) if not isinstance(x, F.Column) else x).cast(t)
        return F.struct((k * 10 + n).alias("id"), text(None if parent is None else k * 10 + parent, "long").alias("parent"), text(name, "string").alias("name"), text(pos, "int").alias("pos"), F.lit(kind).alias("kind"), text(of, "string").alias("value"))

    values = [
        value(0, None, None, None, "dict"),
        value(1, 0, "Status", F.when(even, 0).otherwise(3), "name", F.col("o_orderstatus")),
        value(2, 0, "Priority 1", F.when(even, 1).otherwise(2), "string", F.col("o_orderpriority")),
        value(3, 0, "Rates", F.when(even, 2).otherwise(1), "array"),
        value(4, 3, None, 0, "real", F.when(even, price.cast("string")).otherwise(F.format_string("%.9f", price))),
        value(5, 3, None, 1, "int", year),
        value(6, 0, "Meta", F.when(even, 3).otherwise(0), "dict"),
        value(7, 6, "S", F.when(even, 0).otherwise(1), "name", F.col("o_orderstatus")),
        value(8, 6, "T", F.when(even, 1).otherwise(0), "bool", F.lit("true")),
    ]
    return table(spark, sf_dir, "orders").select(F.inline(F.array(*values)))


def canonical_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.equal_objects(order_objects(spark, sf_dir), [])


def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_objects(spark, sf_dir).filter(~F.col("kind").isin(*canonical.NESTED))
    return rows.select("id", canonical.plain_text(F.col("kind"), F.col("value")).alias("text"))


QUERIES = {f.__name__: f for f in (revision_chain, revision_errors, chain_entries, merged_objects, merged_edges, canonical_objects, canonical_values)}

_CHAIN = """r AS (
  SELECT l_suppkey AS doc, l_orderkey AS k, l_partkey AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem WHERE l_linenumber <= 6
), s AS (
  SELECT doc, n * 100 AS "offset", CASE WHEN n > 1 THEN (n - 1) * 100 WHEN doc % 7 = 0 THEN 300 WHEN doc % 11 = 3 THEN 7 END AS prev, CASE WHEN n % 3 = 0 THEN n * 100 + 50 END AS stm FROM r
  UNION ALL SELECT doc, n * 100 + 50, NULL, NULL FROM r WHERE n % 3 = 0 AND (doc % 13 <> 5 OR n <> 6)
), w AS (
  SELECT doc, max(n) * 100 AS "offset", 0::BIGINT AS rank, [max(n) * 100] AS way FROM r GROUP BY doc
  UNION ALL SELECT w.doc, s.prev, w.rank + 1, list_append(w.way, s.prev) FROM w JOIN s USING (doc, "offset") WHERE s.prev IS NOT NULL AND NOT list_contains(w.way, s.prev)
), c AS MATERIALIZED (
  SELECT w.doc, w."offset", w.rank, s.stm, s.doc IS NULL OR s.stm IS NOT NULL AND t.doc IS NULL AS lost
  FROM w LEFT JOIN s USING (doc, "offset") LEFT JOIN s t ON t.doc = w.doc AND t."offset" = s.stm
), bad AS (
  SELECT doc, CASE WHEN count(*) > 512 THEN 'the chain has more than 512 sections' WHEN bool_or(lost) THEN 'a section is missing' END AS error FROM c GROUP BY doc
), good AS (SELECT doc, "offset", rank, stm FROM c WHERE doc IN (SELECT doc FROM bad WHERE error IS NULL))"""
_MERGED = """l AS (
  SELECT l_orderkey AS doc_id, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem
), d AS (SELECT DISTINCT doc_id, doc_id % 50 AS merged_id FROM l
), o AS (
  SELECT doc_id, 1 AS id, 'Catalog' AS kind FROM d UNION ALL SELECT doc_id, 2, 'Pages' FROM d UNION ALL SELECT doc_id, 10 + 2 * n, 'Page' FROM l UNION ALL SELECT doc_id, 11 + 2 * n, 'Stream' FROM l
), ends AS (SELECT merged_id, max(doc_id) AS first_doc, min(doc_id) AS last_doc FROM d GROUP BY merged_id
), k AS (
  SELECT merged_id, row_number() OVER (PARTITION BY merged_id ORDER BY -doc_id, id) AS num, kind, doc_id, id
  FROM o JOIN d USING (doc_id) JOIN ends USING (merged_id) WHERE kind IN ('Page', 'Stream') OR doc_id = first_doc
), one AS (SELECT merged_id, max(num) FILTER (WHERE kind = 'Catalog') AS cat, max(num) FILTER (WHERE kind = 'Pages') AS tree FROM k GROUP BY merged_id)"""
_PRICE = "round(o_totalprice / 100000) / 4.0::DOUBLE"
ORACLES = {
    "canonical_objects": f"SELECT o_orderkey * 10 AS id, min(o_orderkey * 10) OVER (PARTITION BY o_orderstatus, o_orderpriority, {_PRICE}, year(o_orderdate)) AS canonical FROM orders",
    "canonical_values": f"""SELECT o_orderkey * 10 + n AS id, CASE n WHEN 1 THEN '/' || o_orderstatus WHEN 7 THEN '/' || o_orderstatus WHEN 2 THEN '(' || o_orderpriority || ')' WHEN 5 THEN CAST(year(o_orderdate) AS VARCHAR)
      WHEN 8 THEN 'true' ELSE regexp_replace(printf('%.6f', {_PRICE}), '\\.?0+$', '') END AS text FROM orders, (VALUES (1), (2), (4), (5), (7), (8)) v(n)""",
    "revision_chain": f'WITH RECURSIVE {_CHAIN} SELECT doc, "offset", rank, stm FROM good',
    "revision_errors": f"WITH RECURSIVE {_CHAIN} SELECT doc, error FROM bad WHERE error IS NOT NULL",
    "chain_entries": f"""WITH RECURSIVE {_CHAIN}, t AS (
      SELECT g.doc, p % 20 AS num, rank, 1 AS own, 'o' || k AS entry FROM good g JOIN r ON r.doc = g.doc AND r.n * 100 = g."offset"
      UNION ALL SELECT g.doc, (p + k) % 20, rank, 0, 's' || k FROM good g JOIN r ON r.doc = g.doc AND r.n * 100 + 50 = g.stm)
      SELECT doc, num, CAST(0 AS INTEGER) AS gen, min_by(entry, (rank, own, entry)) AS entry FROM t GROUP BY doc, num""",
    "merged_objects": f"WITH {_MERGED} SELECT merged_id, num, kind, CASE WHEN kind = 'Catalog' THEN last_doc ELSE doc_id END AS doc_id, CAST(id AS BIGINT) AS id FROM k JOIN ends USING (merged_id)",
    "merged_edges": f"""WITH {_MERGED} SELECT merged_id, cat AS src, tree AS dst FROM one
      UNION ALL SELECT merged_id, num, tree FROM k JOIN one USING (merged_id) WHERE kind = 'Page' UNION ALL SELECT merged_id, tree, num FROM k JOIN one USING (merged_id) WHERE kind = 'Page'
      UNION ALL SELECT merged_id, a.num, b.num FROM k a JOIN k b USING (merged_id, doc_id) WHERE a.kind = 'Page' AND b.id = a.id + 1
      UNION ALL SELECT merged_id, num, cat FROM k JOIN one USING (merged_id) JOIN l ON l.doc_id = k.doc_id AND k.id = 11 + 2 * l.n WHERE kind = 'Stream' AND p % 2 = 1""",
}
