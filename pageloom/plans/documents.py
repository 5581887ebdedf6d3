"""Queries on documents as wholes over the order tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.operators import batch, documents
from pageloom.operators.sequence import parse_pages
from pageloom.plans.geometry import _r, rounded
from pageloom.sources.tables import table

KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate", "Other")


def _pick(values: tuple[str, ...], n) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries of a user's document information."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), _pick(KEYS, F.col("event_id")).alias("key"), F.concat("event_type", "event_id").alias("value"), F.col("event_id").alias("ord"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.info_columns(entries(spark, sf_dir))


def metadata_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's title and producer set, its author left as it is."""
    rows = entries(spark, sf_dir)
    last = rows.groupBy("doc_id", "key").agg(F.max_by("value", "ord").alias("value"))
    updates = rows.select("doc_id").distinct().select("doc_id", F.explode(F.map_from_arrays(F.array(F.lit("Title"), F.lit("Author"), F.lit("Producer")), F.array(F.lit("T"), F.lit(None), F.lit("P")))).alias("key", "value"))
    return documents.set_info(last, updates)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as its pages, in an order without ties but for equal rows."""
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    numbered = documents.numbered(rows, ["l_orderkey"], order)
    return numbered.select(F.col("l_orderkey").alias("doc_id"), "page", F.col("l_partkey").alias("num"), (F.col("l_suppkey") % 4 * 90).cast("int").alias("rotate"), (F.col("l_quantity") * 10).alias("width"), (F.col("l_quantity") * 14).alias("height"))


def pages_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 2 and 3 of even orders, all pages of odd ones, turned by 270 degrees."""
    asked = F.when(F.col("doc_id") % 2 == 0, F.lit("2-3")).otherwise("")
    return documents.rotate(pages(spark, sf_dir), parse_pages(asked, F.lit(1000)), 270)


def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(4))).alias("page"))
    return documents.page_list_errors(pages(spark, sf_dir), wanted)


def page_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of nations, customers and orders, each under the one before; some have no area, those of orders begin at the far corner."""
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    box = lambda w, h: F.array(F.lit(0.0), F.lit(0.0), w.cast("double"), h.cast("double"))
    key = lambda letter, k: F.concat(F.lit(letter), F.col(k).cast("string"))
    nodes = n.select(key("n", "n_nationkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.when(F.col("n_nationkey") % 2 == 0, box(F.col("n_nationkey") * 10, F.lit(100))).alias("box"))
    nodes = nodes.unionByName(c.select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent"), F.when(F.col("c_custkey") % 3 == 0, box(F.col("c_custkey") % 5, F.lit(50))).alias("box")))
    nodes = nodes.unionByName(o.select(key("o", "o_orderkey").alias("id"), key("c", "o_custkey").alias("parent"), F.when(F.col("o_orderkey") % 5 == 0, F.reverse(box(F.col("o_orderkey") % 2, F.lit(7)))).alias("box")))
    return documents.page_sizes(nodes, [])


def image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = documents.fit_image((F.col("p_size") * 30).cast("double"), (F.col("p_partkey") % 997 + 1).cast("double"))
    return rounded(table(spark, sf_dir, "part").select("p_partkey", fit.alias("f")).select("p_partkey", "f.*"))


def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "page", documents.image_names(F.concat(F.lit("doc"), "doc_id"), F.col("page")).alias("name"), F.lit(150 / 72).alias("scale"))


def image_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pictures, lines as where they are drawn."""
    p = F.col("p_partkey")
    images = table(spark, sf_dir, "part").select(p.alias("image_id"), (F.col("p_size") * 400).alias("width"), (p % 20 * 300).cast("int").alias("height"), F.when(p % 7 == 0, 1).otherwise(8).alias("bits"), (p % 11 == 0).alias("mask"), (p % 2 == 0).alias("dct"), (p % 3 > 0).alias("supported"))
    drawn = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("image_id")).agg((F.max("l_quantity") * 20).alias("w"), (F.max("l_tax") * 9000).alias("h"))
    return documents.image_plans(images, drawn)


def live_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects; those with a status of their own are excluded."""
    o = F.col("o_orderkey")
    objects = table(spark, sf_dir, "orders").select(o.alias("id"), (o % 13 == 0).alias("free"), F.when(o % 17 == 0, "Null").otherwise("Dictionary").alias("kind"), F.when(o % 5 == 0, _pick(("XRef", "ObjStm", "Page"), o)).alias("type_name"))
    excluded = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(o.alias("id"))
    return documents.live_objects(objects, excluded, ["id"])


def size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coded form of each document beside the text; the smaller one is kept."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("old_bytes"), F.when(F.col("doc_id") % 9 != 0, F.octet_length(F.regexp_replace("text", "[aeiou ]", "")) + F.lit(200)).alias("new_bytes"))
    return documents.smaller(rows, "old_bytes", "new_bytes")


def repair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("before"), F.when(d % 3 != 0, F.col("n_chars") - 1).alias("rewrite_bytes"), F.when(d % 2 == 0, F.col("n_chars") * 9).alias("raster_bytes"))
    return documents.repair_report(rows, dpi=9000)


def annotation_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mark on the first page of each document and one on a page that few have."""
    every = pages(spark, sf_dir)
    base = every.limit(0).select("doc_id", "page", F.lit("Text").alias("subtype"), *[F.lit(0.0).alias(c) for c in ("llx", "lly", "urx", "ury", "opacity")])
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(6))).alias("page"), F.when(F.col("o_orderkey") % 2 == 0, "Highlight").otherwise("Square").alias("subtype"), F.lit(0.25).alias("x0"), F.lit(0.75).alias("y0"), F.lit(0.5).alias("x1"), F.lit(0.5).alias("y1"))
    return rounded(documents.add_annotations(base, new, every))


def widget_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an order as its form's widgets, some on a page that is not there."""
    every = pages(spark, sf_dir)
    one = every.groupBy("doc_id", F.col("num").alias("page_num")).agg(F.min("page").alias("page"), F.min_by("width", "page").alias("width"), F.min_by("height", "page").alias("height"))
    widgets = one.select("doc_id", F.when(F.col("page") % 2 == 0, -1).otherwise(F.col("page_num")).alias("page_num"), F.col("page").alias("widget"))
    return rounded(documents.widget_pages(widgets, one))


def form_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of parts, replaced by suppliers' balances, replaced by customers' ones, where the numbers meet."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))
    local = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    given = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return documents.overlay(base, local, given, keys=["k"], value="v")


def cache_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts looked up in memory, the session, the disk."""
    level = lambda n: table(spark, sf_dir, "part").filter(F.col("p_size") > n).select("p_partkey", F.concat(F.lit(f"over {n}: "), "p_name").alias("value"))
    return documents.cache_levels(table(spark, sf_dir, "part").select("p_partkey"), [level(40), level(25), level(10)], ["p_partkey"], "value")


def cache_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of wide pages under their places once every document is turned back to front."""
    every = pages(spark, sf_dir)
    totals = every.groupBy("doc_id").agg(F.max("page").alias("total"))
    order = every.join(totals, "doc_id").select("doc_id", (F.col("total") + 1 - F.col("page")).alias("page"), F.col("page").alias("old_page"))
    return documents.seed_cache(every.filter("width > 250").select("doc_id", "page", F.col("num").alias("value")), order)


def sidecar_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as a conversation's JSON attachment and read again; one conversation's is spoilt."""
    comments = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), "text", (F.col("turn") % 2 == 0).alias("resolved"))
    files = documents.to_sidecar(comments)
    files = files.withColumn("sidecar", F.when(F.col("doc_id") % 10 == 3, F.lit("{not json")).otherwise(F.col("sidecar")))
    return documents.from_sidecar(files, "id: bigint, text: string, resolved: boolean")


def roomiest_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand as disks: size by price, room by number."""
    disks = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("disk"), F.col("p_partkey").alias("total"), (F.col("p_size") * 40).cast("long").alias("available"))
    return documents.roomiest(disks, ["p_brand"])


def canvas_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = documents.canvas_size(F.col("p_size") * 40.0, F.col("p_partkey") % 40 / 10.0 + 0.25, F.when(F.col("p_partkey") % 6 > 0, F.col("p_partkey") % 6 / 2.0))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.*")


def titles_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes and back, with their base64 in one line."""
    text = F.col("text")
    encoded = F.regexp_replace(F.base64(text.cast("binary")), "\\s", "")
    return table(spark, sf_dir, "documents").select("doc_id", documents.text_of(documents.bytes_of(text)).alias("title"), encoded.alias("encoded"))


def bookmark_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks to the parts of an order and to some that it lacks."""
    every = pages(spark, sf_dir).groupBy("doc_id", "num").agg(F.min("page").alias("page"))
    lacking = F.max("num").over(Window.partitionBy("doc_id")) + 1
    marks = every.select("doc_id", F.col("page").alias("ord"), F.when(F.col("num") % 2 == 0, F.col("num")).otherwise(lacking).alias("dest"))
    return documents.bookmark_pages(marks, every)


def regions_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy("doc_id", (F.col("page") % 2).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("num")), lambda n: n.cast("string")), ",").alias("regions"))


def batch_run(spark: SparkSession, sf_dir: str) -> batch.Batch:
    """A request for each order, one in seven of an operation that is not there, one in 31 for a document that is not."""
    k = F.col("o_orderkey")
    listed = F.when(k % 3 == 0, F.array(F.lit(1), F.lit(3))).when(k % 3 == 1, F.array(F.lit(1), F.lit(1))).when(k % 5 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(2), F.lit(1)))
    requests = table(spark, sf_dir, "orders").select(k.alias("request_id"), F.when(k % 31 == 0, k + 1_000_000_000).otherwise(k).alias("doc_id"), _pick((*batch.OPERATIONS, "shred"), k).alias("op"), listed.alias("pages"), (k % 8 * 45).cast("int").alias("degrees"), (k % 4).cast("int").alias("size"))
    return batch.run(requests, pages(spark, sf_dir))


def batch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_run(spark, sf_dir).pages


def batch_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_run(spark, sf_dir).errors


QUERIES = {f.__name__: f for f in (batch_pages, batch_errors, metadata, metadata_update, pages_rotated, missing_pages, page_dims, image_fit, image_names, image_plan, live_objects, size_guard, repair_report, annotation_added, widget_pages, form_overlay, cache_levels, cache_seeded, sidecar_roundtrip, roomiest_disk, canvas_sizes, titles_decoded, bookmark_pages, regions_by_page)}

ENTRIES = "e AS (SELECT user_id AS doc_id, ['Title', 'Author', 'Subject', 'Keywords', 'Creator', 'Producer', 'CreationDate', 'ModDate', 'Other'][event_id % 9 + 1] AS key, event_type || event_id AS value, event_id AS ord FROM events)"
PAGES = "p AS (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) AS INTEGER) AS page, l_partkey AS num, CAST(l_suppkey % 4 * 90 AS INTEGER) AS rotate, l_quantity * 10 AS width, l_quantity * 14 AS height FROM lineitem)"
ONE = "o AS (SELECT doc_id, num, min(page) AS page, arg_min(width, page) AS width, arg_min(height, page) AS height FROM p GROUP BY doc_id, num)"


def _plan(pixels: str, points: str) -> str:
    return f"CASE WHEN {points} >= 1 AND {pixels} / ({points} / 72) > 225 THEN greatest(round({pixels} * (150 / ({pixels} / ({points} / 72)))), 1.0) ELSE {pixels} END"


def _cut(x: str) -> str:
    return f"CASE WHEN greatest(w, h) > 3000 THEN greatest(round({x} * (3000 / greatest(w, h))), 1.0) ELSE {x} END"


REQUESTS = f"""{PAGES}, t AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS total FROM p GROUP BY doc_id),
  q AS (SELECT k AS request_id, CASE WHEN k % 31 = 0 THEN k + 1000000000 ELSE k END AS doc_id, ['rotate', 'remove', 'reorder', 'extract', 'split', 'reverse', 'shred'][k % 7 + 1] AS op,
    CASE WHEN k % 3 = 0 THEN [1, 3] WHEN k % 3 = 1 THEN [1, 1] WHEN k % 5 = 0 THEN [] ELSE [2, 1] END AS pages, k % 8 * 45 AS degrees, k % 4 AS size FROM (SELECT o_orderkey AS k FROM orders)),
  j AS (SELECT q.*, total FROM q LEFT JOIN t USING (doc_id)),
  b AS (SELECT *, CASE WHEN total IS NULL THEN 'not found|no such document' WHEN op = 'shred' THEN 'invalid input|unknown operation shred'
    WHEN op = 'rotate' AND degrees NOT IN (90, 180, 270) THEN 'invalid input|Degrees must be 90, 180, or 270' WHEN op IN ('remove', 'extract') AND len(pages) = 0 THEN 'invalid input|No pages specified'
    WHEN op = 'reorder' AND len(pages) <> total THEN 'invalid input|Order length ' || len(pages) || ' doesn''t match page count ' || total
    WHEN op IN ('remove', 'extract', 'reorder') AND list_max(pages) > total THEN 'invalid input|Page ' || pages[CASE WHEN pages[1] > total THEN 1 ELSE 2 END] || ' out of range (1-' || total || ')'
    WHEN op = 'remove' AND len(list_distinct(pages)) >= total THEN 'invalid input|Cannot remove all pages from a PDF'
    WHEN op = 'reorder' AND len(list_distinct(pages)) < len(pages) THEN 'invalid input|Page ' || pages[1] || ' appears more than once in order'
    WHEN op = 'split' AND size < 1 THEN 'invalid input|Pages per file must be at least 1' END AS bad FROM j)"""
ORACLES = {
    "batch_errors": f"WITH {REQUESTS} SELECT request_id, doc_id, op, split_part(bad, '|', 1) AS code, split_part(bad, '|', 2) AS message FROM b WHERE bad IS NOT NULL",
    "batch_pages": f"""WITH {REQUESTS}, m AS (SELECT *, CASE WHEN op IN ('reorder', 'extract') THEN pages WHEN op = 'remove' THEN list_filter(range(1, total + 1), lambda x: NOT list_contains(pages, x)) WHEN op = 'reverse' THEN list_reverse(range(1, total + 1)) ELSE range(1, total + 1) END AS made FROM b WHERE bad IS NULL),
      u AS (SELECT *, unnest(made) AS page, generate_subscripts(made, 1) - 1 AS i FROM m)
      SELECT request_id, doc_id, CAST(CASE WHEN op = 'split' THEN i // size ELSE 0 END + 1 AS INTEGER) AS part, CAST(CASE WHEN op = 'split' THEN i % size ELSE i END + 1 AS INTEGER) AS position, CAST(page AS INTEGER) AS page,
        CAST(CASE WHEN op = 'rotate' AND (len(pages) = 0 OR list_contains(pages, page)) THEN degrees ELSE 0 END AS INTEGER) AS turn FROM u""",
    "metadata": f"WITH {ENTRIES} SELECT doc_id, " + ", ".join(f"arg_max(value, ord) FILTER (WHERE key = '{k}') AS {k.lower()}" for k in KEYS[:8]) + " FROM e GROUP BY doc_id",
    "metadata_update": f"WITH {ENTRIES}, l AS (SELECT doc_id, key, arg_max(value, ord) AS value FROM e GROUP BY 1, 2), u AS (SELECT DISTINCT doc_id, 'Title' AS key FROM e) SELECT doc_id, key, CASE WHEN key = 'Title' THEN 'T' ELSE value END AS value FROM l FULL JOIN u USING (doc_id, key)",
    "pages_rotated": f"WITH {PAGES} SELECT doc_id, page, CASE WHEN doc_id % 2 = 1 OR page IN (2, 3) THEN (rotate + 270) % 360 ELSE rotate END AS rotate FROM p",
    "missing_pages": f"WITH {PAGES} SELECT doc_id, page FROM (SELECT o_orderkey AS doc_id, unnest([1, 4]) AS page FROM orders) w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = w.doc_id AND p.page = w.page)",
    "page_dims": """WITH RECURSIVE n AS (SELECT 'n' || n_nationkey AS id, NULL AS parent, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey * 10.0 END::DOUBLE AS w, 100.0::DOUBLE AS h FROM nation
      UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 5 END, 50 FROM customer
      UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 7 END, o_orderkey % 2 FROM orders),
      g AS (SELECT id, parent, w > 0 AND h > 0 AS ok, w, h FROM n), r AS (SELECT id, parent AS up, coalesce(ok, false) AS ok, w, h FROM g UNION ALL SELECT r.id, g.parent, coalesce(g.ok, false), g.w, g.h FROM r JOIN g ON g.id = r.up WHERE NOT r.ok)
      SELECT id, CASE WHEN ok THEN w ELSE 595.0 END AS width, CASE WHEN ok THEN h ELSE 842.0 END AS height FROM r WHERE ok OR up IS NULL""",
    "image_fit": f"SELECT p_partkey, {_r('w')} AS w, {_r('h')} AS h, {_r('(210 - w) / 2')} AS x, {_r('(297 - h) / 2')} AS y FROM (SELECT p_partkey, CASE WHEN a > 190 / 270::DOUBLE THEN 190 ELSE a * 270 END AS w, CASE WHEN a > 190 / 270::DOUBLE THEN 190 / a ELSE 270 END AS h FROM (SELECT p_partkey, p_size * 30.0::DOUBLE / (p_partkey % 997 + 1) AS a FROM part))",
    "image_names": f"WITH {PAGES} SELECT doc_id, page, 'doc' || doc_id || '_' || printf('%04d', page) || '.png' AS name, 150 / 72::DOUBLE AS scale FROM p",
    "image_plan": f"""WITH i AS (SELECT p_partkey AS k, (p_size * 400)::DOUBLE AS pw, (p_partkey % 20 * 300)::DOUBLE AS ph, coalesce(w, 0) AS dw, coalesce(h, 0) AS dh FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) * 20 AS w, max(l_tax) * 9000 AS h FROM lineitem GROUP BY 1) d ON l_partkey = p_partkey
      WHERE p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_size > 0 AND p_partkey % 20 > 0 AND (p_partkey % 2 = 0 OR p_partkey % 3 > 0) AND p_size * 400 * (p_partkey % 20 * 300) <= 120000000),
      s AS (SELECT k, pw, ph, {_plan('pw', 'dw')} AS w, {_plan('ph', 'dh')} AS h FROM i), t AS (SELECT k, pw, ph, CAST(greatest(least({_cut('w')}, pw), 1) AS INTEGER) AS tw, CAST(greatest(least({_cut('h')}, ph), 1) AS INTEGER) AS th FROM s)
      SELECT k AS image_id, tw AS target_w, th AS target_h FROM t WHERE k % 2 = 1 OR tw <> pw OR th <> ph""",
    "live_objects": "SELECT id, free, kind, type_name FROM (SELECT o_orderkey AS id, o_orderkey % 13 = 0 AS free, CASE WHEN o_orderkey % 17 = 0 THEN 'Null' ELSE 'Dictionary' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN ['XRef', 'ObjStm', 'Page'][o_orderkey % 3 + 1] END AS type_name, o_orderstatus FROM orders) WHERE NOT free AND kind <> 'Null' AND coalesce(type_name, '') NOT IN ('XRef', 'ObjStm') AND o_orderstatus <> 'P'",
    "size_guard": "SELECT doc_id, CAST(o AS INTEGER) AS old_bytes, CAST(n AS INTEGER) AS new_bytes, CASE WHEN n < o THEN 'new' ELSE 'old' END AS kept, CAST(CASE WHEN n < o THEN n ELSE o END AS INTEGER) AS bytes FROM (SELECT doc_id, strlen(text) AS o, CASE WHEN doc_id % 9 <> 0 THEN strlen(regexp_replace(text, '[aeiou ]', '', 'g')) + 200 END AS n FROM documents)",
    "repair_report": "SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'rewrite' WHEN doc_id % 2 = 0 THEN 'raster' ELSE 'failed' END AS mode, n_chars AS before, CASE WHEN doc_id % 3 <> 0 THEN n_chars - 1 WHEN doc_id % 2 = 0 THEN n_chars * 9 END AS after, CAST(CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 600 END AS INTEGER) AS dpi FROM documents",
    "annotation_added": f"WITH {PAGES} SELECT doc_id, page, CASE WHEN doc_id % 2 = 0 THEN 'Highlight' ELSE 'Square' END AS subtype, {_r('0.25 * width')} AS llx, {_r('0.25 * height')} AS lly, {_r('0.5 * width')} AS urx, {_r('0.5 * height')} AS ury, CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS opacity FROM p JOIN orders ON o_orderkey = doc_id WHERE page IN (1, 6)",
    "widget_pages": f"WITH {PAGES}, {ONE} SELECT w.doc_id, w.page AS widget, CASE WHEN w.page % 2 = 0 THEN 1 ELSE w.page END AS page, {_r('coalesce(o.width, 612.0)')} AS width, {_r('coalesce(o.height, 792.0)')} AS height FROM o w LEFT JOIN o ON o.doc_id = w.doc_id AND o.page = CASE WHEN w.page % 2 = 0 THEN 1 ELSE w.page END",
    "form_overlay": "SELECT p_partkey AS k, coalesce(c_acctbal, s_acctbal, p_retailprice) AS v FROM part LEFT JOIN supplier ON s_suppkey = p_partkey LEFT JOIN customer ON c_custkey = p_partkey AND c_acctbal > 0",
    "cache_levels": "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'over 40: ' || p_name WHEN p_size > 25 THEN 'over 25: ' || p_name WHEN p_size > 10 THEN 'over 10: ' || p_name END AS value, CAST(CASE WHEN p_size > 40 THEN 1 WHEN p_size > 25 THEN 2 WHEN p_size > 10 THEN 3 ELSE 0 END AS INTEGER) AS level FROM part",
    "cache_seeded": f"WITH {PAGES} SELECT doc_id, total + 1 - page AS page, num AS value FROM p JOIN (SELECT doc_id, max(page) AS total FROM p GROUP BY doc_id) t USING (doc_id) WHERE width > 250",
    "sidecar_roundtrip": "SELECT conv_id AS doc_id, turn AS id, text, turn % 2 = 0 AS resolved FROM conversations WHERE conv_id % 10 <> 3",
    "roomiest_disk": "SELECT p_brand, max(p_partkey) AS disk, max(p_partkey) AS total, greatest(max(p_partkey) - arg_max(p_size * 40, p_partkey), 0) AS used FROM part GROUP BY p_brand",
    "canvas_sizes": "SELECT p_partkey, CAST(CASE WHEN greatest(w, h) > 2600 THEN greatest(1, round(w * (2600 / greatest(w, h)))) ELSE w END AS BIGINT) AS width, CAST(CASE WHEN greatest(w, h) > 2600 THEN greatest(1, round(h * (2600 / greatest(w, h)))) ELSE h END AS BIGINT) AS height FROM (SELECT p_partkey, w, greatest(1, round(w * (p_partkey % 40 / 10.0::DOUBLE + 0.25::DOUBLE))) AS h FROM (SELECT p_partkey, greatest(1, round(p_size * 40.0::DOUBLE * greatest(1.0::DOUBLE, least(2.0::DOUBLE, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 6 / 2.0::DOUBLE ELSE 1 END)))) AS w FROM part))",
    "titles_decoded": "SELECT doc_id, text AS title, base64(encode(text)) AS encoded FROM documents",
    "bookmark_pages": f"WITH {PAGES}, {ONE} SELECT doc_id, page AS ord, page FROM o WHERE num % 2 = 0",
    "regions_by_page": f"WITH {PAGES} SELECT doc_id, page % 2 AS page, string_agg(num, ',' ORDER BY num) AS regions FROM p GROUP BY doc_id, page % 2",
}
