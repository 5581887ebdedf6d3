"""Queries on trees and object graphs made of the order tables and documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import graph, outline, trees
from pageloom.sources.tables import table


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as one tree; ids carry a letter for their level."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    regions = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").cast("long").alias("ord"), F.lit(None).cast("string").alias("value"))
    nations = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent"), F.col("n_nationkey").cast("long").alias("ord"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("value"))
    customers = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent"), F.col("c_custkey").alias("ord"), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("value"))
    orders = table(spark, sf_dir, "orders").select(key("o", "o_orderkey").alias("id"), key("c", "o_custkey").alias("parent"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("value"))
    return regions.unionByName(nations).unionByName(customers).unionByName(orders)


def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = graph.checkpointed(trees.walk(tree(spark, sf_dir), []))
    path = trees.paths(walked.withColumn("name", F.col("id")), [], "name", ["root", "depth"])
    return path.select("root", "id", F.col("depth").cast("int").alias("depth"), F.array_join("path", "/").alias("path"))


def shared_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree with more ways in: some customers also under the next nation, some nations under Africa and under a nation before them."""
    rows = tree(spark, sf_dir).select("id", "parent", "ord")
    key = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    c, n = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0"), table(spark, sf_dir, "nation").filter("n_nationkey % 4 = 1")
    more = c.select(key("c", F.col("c_custkey")).alias("id"), key("n", (F.col("c_nationkey") + 1) % 25).alias("parent"), F.col("c_custkey").cast("long").alias("ord"))
    more = more.unionByName(n.select(key("n", F.col("n_nationkey")).alias("id"), F.lit("r0").alias("parent"), (F.col("n_nationkey") * 7 % 25).cast("long").alias("ord")))
    return rows.unionByName(more).unionByName(n.select(key("n", F.col("n_nationkey")).alias("id"), key("n", F.col("n_nationkey") - 1).alias("parent"), F.lit(5).cast("long").alias("ord")))


def tree_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.walk(shared_tree(spark, sf_dir), [])


def nearest_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.nearest_ancestor(tree(spark, sf_dir), [], "value")


def object_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References from orders to parts, parts to suppliers, suppliers to nations, nations to regions; some come more than once."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    lines = table(spark, sf_dir, "lineitem")
    parts = lines.select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst"))
    suppliers = lines.select(key("p", "l_partkey").alias("src"), key("s", "l_suppkey").alias("dst"))
    nations = table(spark, sf_dir, "supplier").select(key("s", "s_suppkey").alias("src"), key("n", "s_nationkey").alias("dst"))
    regions = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("src"), key("r", "n_regionkey").alias("dst"))
    return parts.unionByName(suppliers).unionByName(nations).unionByName(regions)


def reachable_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the dearest orders reach."""
    roots = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.concat(F.lit("o"), "o_orderkey").alias("id"))
    return graph.reachable(object_edges(spark, sf_dir), roots, [])


def doc_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 50 == 7, "Page").otherwise("Stream").alias("kind"), F.col("text").alias("body"))


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.canonical(doc_objects(spark, sf_dir), ["lang"], "body")


def dedup_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object refers to the one of half its number; equal ones are merged within a language."""
    edges = doc_objects(spark, sf_dir).select("lang", F.col("id").alias("src"), F.floor(F.col("id") / 2).alias("dst"))
    return graph.remap_edges(edges, dedup_exact(spark, sf_dir), ["lang"])


def revision_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one number are revisions of an entry, the latest shipped is the newest."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity")
    return graph.newest_revision(rows, ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey", "l_quantity"])


def object_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer's nation by hundreds."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return graph.batches(rows.select("c_nationkey", F.col("o_orderkey").alias("id")), ["c_nationkey"])


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of every line; a missing one is null, not an error."""
    wanted = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") * 2).alias("o_orderkey")).agg(F.count("*").alias("lines"))
    return wanted.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "left")


def outline_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.wire_siblings(tree(spark, sf_dir), [])


MILLION = 1_000_000


def compress_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as objects, a million to a file, that refer to those of twice their number: deduplicated, then those that number 1 of their file reaches."""
    objects = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / MILLION).alias("doc"), (F.col("doc_id") % MILLION).alias("id"), F.lit("Stream").alias("kind"), F.col("text").alias("body"), F.octet_length("text").alias("bytes"))
    slim = objects.select("doc", "id", "bytes")
    numbers = F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("dst")
    edges = slim.select("doc", F.col("id").alias("src"), numbers).filter("dst % 5 <> 0 and dst <> src")
    mapping = graph.checkpointed(graph.canonical(objects, ["doc"], "body", most_bytes=1 << 30))
    kept = slim.join(mapping.filter("id = canonical").select("doc", "id"), ["doc", "id"], "left_semi")
    live = graph.checkpointed(graph.remap_edges(edges, mapping, ["doc"]).join(kept.select("doc", F.col("id").alias("dst")), ["doc", "dst"], "left_semi"))
    roots = mapping.filter("id = 1").select("doc", F.col("canonical").alias("id"))
    out = graph.keep_reachable(kept, live, roots, ["doc"])
    return out.agg(F.count("*").alias("objects"), F.sum("bytes").alias("bytes"), F.sum("id").alias("ids"))


QUERIES = {f.__name__: f for f in (tree_walk, tree_numbers, nearest_ancestor, reachable_gc, dedup_exact, dedup_remap, revision_merge, object_batches, point_lookup, outline_wire, compress_pipeline)}

TREE = """tree AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent, CAST(r_regionkey AS BIGINT) AS ord, NULL AS value FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name END FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, CASE WHEN c_acctbal > 5000 THEN c_mktsegment END FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END FROM orders
)"""
EDGES = """edges AS (
  SELECT DISTINCT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem
  UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
)"""
CANON = "SELECT lang, doc_id AS id, CASE WHEN doc_id % 50 = 7 OR strlen(text) > 65536 THEN doc_id ELSE min(doc_id) FILTER (WHERE doc_id % 50 <> 7) OVER (PARTITION BY lang, text) END AS canonical FROM documents"
ORACLES = {
    "tree_walk": f"WITH RECURSIVE {TREE}, w AS (SELECT id AS root, id, 0 AS depth, id AS path FROM tree WHERE parent IS NULL UNION ALL SELECT w.root, t.id, w.depth + 1, w.path || '/' || t.id FROM w JOIN tree t ON t.parent = w.id) SELECT * FROM w",
    "tree_numbers": f"""WITH RECURSIVE {TREE}, t2 AS (
      SELECT id, parent, ord FROM tree UNION ALL SELECT 'c' || c_custkey, 'n' || (c_nationkey + 1) % 25, c_custkey FROM customer WHERE c_custkey % 10 = 0
      UNION ALL SELECT 'n' || n_nationkey, 'r0', n_nationkey * 7 % 25 FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey - 1), 5 FROM nation WHERE n_nationkey % 4 = 1
    ), e AS (SELECT id, parent, min(ord) AS ord FROM t2 GROUP BY ALL
    ), w AS (
      SELECT id AS root, id, parent, 0::BIGINT AS depth, [{{'o': ord, 'i': id}}] AS way FROM e WHERE parent IS NULL
      UNION ALL SELECT w.root, e.id, e.parent, w.depth + 1, list_append(w.way, {{'o': e.ord, 'i': e.id}}) FROM w JOIN e ON e.parent = w.id
    ), f AS MATERIALIZED (SELECT id, min_by({{'root': root, 'parent': parent, 'depth': depth}}, way) AS x, min(way) AS way FROM w GROUP BY id
    ), u AS (SELECT id, x.parent AS up FROM f UNION ALL SELECT u.id, f.x.parent FROM u JOIN f ON f.id = u.up)
    SELECT id, x.parent AS parent, x.root AS root, x.depth AS depth, row_number() OVER (ORDER BY way) - 1 AS n, 1 + coalesce(below, 0) AS size
    FROM f LEFT JOIN (SELECT up AS id, count(*) AS below FROM u WHERE up IS NOT NULL GROUP BY up) USING (id)""",
    "nearest_ancestor": f"WITH RECURSIVE {TREE}, w AS (SELECT id, id AS here, parent, value, 0 AS hops FROM tree UNION ALL SELECT w.id, t.id, t.parent, t.value, w.hops + 1 FROM w JOIN tree t ON t.id = w.parent WHERE w.value IS NULL) SELECT id, value, CASE WHEN value IS NOT NULL THEN hops END AS hops FROM w WHERE value IS NOT NULL OR parent IS NULL",
    "reachable_gc": f"WITH RECURSIVE {EDGES}, w AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_totalprice > 400000 UNION SELECT e.dst FROM w JOIN edges e ON e.src = w.id) SELECT id FROM w",
    "dedup_exact": CANON,
    "dedup_remap": f"WITH m AS ({CANON}) SELECT d.lang, d.id AS src, coalesce(t.canonical, d.id // 2) AS dst FROM m d LEFT JOIN m t ON t.lang = d.lang AND t.id = d.id // 2 WHERE d.id = d.canonical",
    "revision_merge": "SELECT l_orderkey, l_linenumber, r.a AS l_shipdate, r.b AS l_partkey, r.c AS l_suppkey, r.d AS l_quantity FROM (SELECT l_orderkey, l_linenumber, max({'a': l_shipdate, 'b': l_partkey, 'c': l_suppkey, 'd': l_quantity}) AS r FROM lineitem GROUP BY 1, 2)",
    "object_batches": "SELECT c_nationkey, o_orderkey AS id, (row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) - 1) // 100 AS batch FROM orders JOIN customer ON o_custkey = c_custkey",
    "point_lookup": "SELECT w.o_orderkey, lines, o_orderstatus FROM (SELECT l_orderkey * 2 AS o_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) w LEFT JOIN orders USING (o_orderkey)",
    "outline_wire": f"WITH {TREE}, k AS (SELECT parent AS id, arg_min(id, (ord, id)) AS first_child, arg_max(id, (ord, id)) AS last_child, count(*) AS n FROM tree WHERE parent IS NOT NULL GROUP BY parent) SELECT t.id, lag(t.id) OVER w AS prev, lead(t.id) OVER w AS next, first_child, last_child, coalesce(n, 0) AS n_children FROM tree t LEFT JOIN k USING (id) WINDOW w AS (PARTITION BY parent ORDER BY ord, t.id)",
    "compress_pipeline": """WITH RECURSIVE m AS (SELECT doc_id // 1000000 AS doc, doc_id % 1000000 AS id, CASE WHEN text IS NULL THEN doc_id % 1000000 ELSE
      min(doc_id % 1000000) OVER (PARTITION BY doc_id // 1000000, text) END AS canonical, strlen(text) AS bytes FROM documents),
      e AS (SELECT doc, id AS src, unnest([id * 2, id * 2 + 1]) AS dst FROM m WHERE id = canonical),
      r AS (SELECT e.doc, e.src, t.canonical AS dst FROM e JOIN m t ON t.doc = e.doc AND t.id = e.dst WHERE e.dst % 5 <> 0 AND e.dst <> e.src),
      w AS (SELECT doc, canonical AS id FROM m WHERE id = 1 UNION SELECT r.doc, r.dst FROM w JOIN r ON r.src = w.id AND r.doc = w.doc),
      k AS (SELECT doc, id FROM w UNION ALL SELECT doc, id FROM m WHERE id = canonical AND doc NOT IN (SELECT doc FROM w))
      SELECT count(*) AS objects, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(id) AS BIGINT) AS ids FROM k JOIN m USING (doc, id)""",
}
