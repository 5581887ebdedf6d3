"""Queries on annotations, comments, links, forms and outlines, with their SQL.

User turns of a conversation stand for notes on a page, assistant turns for stored comments; both are numbered.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions import scalar
from pageloom.operators import annots, forms, outline, redaction
from pageloom.sources import keyed
from pageloom.sources.tables import table
from pageloom.storage import shared_folder

COLORS = ("#f59e0b", "#10B981", "#3b82f6")
KINDS = ("Text", "Highlight", "Square", "Popup", "Widget", "Link")


def _pick(values: tuple[str, ...], n) -> F.Column:
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter(F.col("role") == role)
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return rows.select(F.col("conv_id").alias("doc_id"), "turn", F.concat(F.lit("c"), n).alias("id"), n.alias("n"), "text")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir, "user")
    even = F.col("n") % 2 == 0
    created = F.when(F.col("n") % 3 != 0, F.col("turn") * 1000.0)
    return rows.select("doc_id", "id", "text", F.when(even, _pick(COLORS, F.col("doc_id"))).alias("color"), created.alias("created"), F.when(F.col("n") % 6 != 0, F.col("turn") * 2000.0).alias("modified"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir, "assistant").filter("length(text) > 150")
    text = F.when(F.col("n") % 5 == 0, F.col("text")).otherwise(F.concat(F.lit("stored "), F.col("n")))
    return rows.select("doc_id", "id", text.alias("text"), _pick(COLORS, F.col("n")).alias("color"), (F.col("n") % 2 == 1).alias("resolved"), F.when(F.col("n") % 3 == 1, F.col("turn") * 10.0).alias("created_at"), F.col("text").alias("quote"), (F.col("doc_id") % 2 == 0).alias("synced"), (F.col("n") % 9).cast("int").alias("page"))


def comment_load_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annots.load_comments(notes(spark, sf_dir), stored(spark, sf_dir))


def comment_sync_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("page")).distinct()
    return annots.comment_actions(notes(spark, sf_dir), stored(spark, sf_dir), pages)


def comments_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes kept in a table of buckets, after stored comments are saved into it."""
    path = f"{shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    rows = notes(spark, sf_dir)
    saved = keyed.KeyedTable.create(rows.select("doc_id", "id", "text", "color"), path, ["doc_id", "id"], 8)
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct().select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("page"))
    saved.merge(annots.comment_changes(rows, stored(spark, sf_dir), pages))
    return saved.read()


def comments_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = notes(spark, sf_dir).select("doc_id", "id", "text")
    return annots.merge_in_flight(loaded, stored(spark, sf_dir).select("doc_id", "id", "text"), ["doc_id", "id"])


def comments_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments left open and resolved ones, by document."""
    return stored(spark, sf_dir).groupBy("doc_id").agg(F.count_if(~F.col("resolved")).alias("open"), F.count_if("resolved").alias("resolved"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as annotations of several kinds, four to a page; a popup belongs to the turn before the last note."""
    rows = table(spark, sf_dir, "conversations")
    unit = lambda k: F.round(F.pmod(F.col("conv_id") * k + F.col("turn"), F.lit(100)) / 100.0, 4)
    return rows.select(
        F.col("conv_id").alias("doc_id"),
        (F.floor(F.col("turn") / 4) + 1).cast("int").alias("page"),
        F.col("turn").alias("ord"),
        F.col("turn").alias("id"),
        _pick(KINDS, F.col("turn")).alias("subtype"),
        F.when(F.col("turn") % 3 == 0, _pick(COLORS, F.col("conv_id"))).alias("color"),
        F.when(F.col("turn") % 5 != 4, F.concat(F.col("text"), F.when(F.col("turn") % 2 == 0, F.lit(' "q"')).otherwise(F.lit("")))).alias("contents"),
        (F.col("turn") - 3).alias("parent"),
        *[unit(k).alias(c) for k, c in ((3, "x0"), (5, "y0"), (7, "x1"), (11, "y1"))],
    )


def annotation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annots.known_annotations(annotations(spark, sf_dir)).select("doc_id", "page", "ord", "subtype", "color")


def annotation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annots.annotation_csv(annots.known_annotations(annotations(spark, sf_dir)))


def popup_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annots.popups(annotations(spark, sf_dir))


def links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annots.links_of(table(spark, sf_dir, "pages"))


def link_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    every = annots.links_of(rows).select("page_id", "uri").unionByName(rows.select("page_id", F.col("url").alias("uri")))
    return every.groupBy("page_id").agg(F.count_if(annots.opens_outside(F.col("uri"))).alias("outside"), F.count("*").alias("links"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with an address, a page, both or neither."""
    links = annots.links_of(table(spark, sf_dir, "pages"))
    rows = links.select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), "ord", F.when(F.col("ord") % 3 != 0, F.col("uri")).alias("uri"), F.when(F.col("ord") % 2 == 0, F.col("ord")).alias("dest_page"))
    return annots.page_links(rows)


def links_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link added to each page and its second one taken off; links left by page."""
    links = annots.links_of(table(spark, sf_dir, "pages")).select(F.col("page_id").alias("doc_id"), F.lit(1).alias("page"), "ord", "uri", F.lit(None).cast("int").alias("dest_page"))
    new = links.groupBy("doc_id", "page").agg((F.max("ord") + 1).alias("ord")).select("doc_id", "page", "ord", F.when(F.col("doc_id") % 3 == 0, F.lit("https://example.org")).alias("uri"), F.when(F.col("doc_id") % 3 != 2, F.lit(4)).alias("dest_page"))
    gone = links.select("doc_id", "page", F.lit(1).alias("index")).distinct()
    return annots.remove_link(annots.add_links(links, new), gone)


def boxes_of(rows: DataFrame, *columns: str) -> DataFrame:
    sides = [f(a, b).alias(n) for f, a, b, n in ((F.least, "x0", "x1", "x0"), (F.least, "y0", "y1", "y0"), (F.greatest, "x0", "x1", "x1"), (F.greatest, "y0", "y1", "y1"))]
    return rows.select("doc_id", "page", *columns, *sides)


def redact_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations as glyphs, squares of each page as regions: glyphs left by page."""
    rows = annotations(spark, sf_dir)
    left = redaction.without_met(boxes_of(rows, "ord"), boxes_of(rows.filter("subtype = 'Square'")), ["doc_id", "page"])
    return left.select("doc_id", "page", "ord")


def region_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each annotation with each square of its document that it overlaps, whatever their pages."""
    rows = annotations(spark, sf_dir)
    return redaction.meetings(boxes_of(rows, "ord"), boxes_of(rows.filter("subtype = 'Square'").withColumn("square", F.col("ord")), "square"), ["doc_id"], ["page", "ord"], ["square"])


def redacted(spark: SparkSession, sf_dir: str) -> redaction.Redacted:
    """Odd documents are redacted where their squares are; a document with a number of five has a region on no page."""
    rows = annotations(spark, sf_dir)
    pages = rows.select("doc_id", "page", F.lit(10.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(110.0).alias("x1"), F.lit(50.0).alias("y1")).distinct()
    regions = rows.filter("subtype = 'Square' and doc_id % 2 = 1").select("doc_id", F.when(F.col("page") == 1, 0).otherwise(F.col("page")).alias("page"), "x0", "y0", "x1", "y1")
    regions = regions.unionByName(rows.filter("doc_id % 5 = 0").select("doc_id", F.lit(99).alias("page"), *[F.lit(0.5).alias(c) for c in redaction.SIDES]))
    glyphs = boxes_of(rows, "ord").select("doc_id", "page", "ord", *[(F.col(c) * 100).alias(c) for c in redaction.SIDES])
    keys = rows.select("doc_id", F.explode(F.array(*map(F.lit, ("Title", "Author", "Producer")))).alias("key")).distinct()
    return redaction.redact(glyphs, rows.select("doc_id", "page", "ord", "subtype"), keys, regions, pages)


def redacted_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(spark, sf_dir).glyphs.select("doc_id", "page", "ord")


def redacted_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(spark, sf_dir).annotations


def redacted_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(spark, sf_dir).info


def anonymize_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as keys of a user's document."""
    names = ("Title", "Author", "Metadata", "Names", "OpenAction", "AA", "T", "NM", "Other")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), _pick(("info", "catalog", "annotation"), F.col("event_id")).alias("scope"), _pick(names, F.floor(F.col("event_id") / 3)).alias("key"))
    return annots.anonymize_report(rows, xmp=False)


def lines_with_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents; short ones are set in larger type."""
    from pageloom.operators.text import lines_of

    n = F.length("text")
    size = F.when(n < 12, 20.0).when(n < 30, 16.0).when(n < 60, 13.5).when(n < 100, 12.5).otherwise(10.0)
    rows = lines_of(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "page", F.col("line").alias("ord"), "text", (size + 0.25 * (F.col("line") % 2)).alias("height"))


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.upper_median(lines_with_height(spark, sf_dir), ["doc_id"], "height")


def heading_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.headings(lines_with_height(spark, sf_dir))


def outline_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline.nest(outline.headings(lines_with_height(spark, sf_dir)))


def field_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation a form: its turns are fields, each under the turn of half its number."""
    rows = table(spark, sf_dir, "conversations")
    parent = F.when(F.col("turn") > 0, F.floor((F.col("turn") - 1) / 2))
    kind = F.when((F.col("turn") == 0) | (F.col("turn") % 4 == 1), F.when(F.col("conv_id") % 2 == 0, "Tx").otherwise("Btn"))
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), parent.alias("parent"), F.col("turn").alias("ord"), F.concat(F.lit("f"), "turn").alias("part"), kind.alias("field_type"), F.when(F.col("turn") % 3 == 0, F.col("text")).alias("value"))


def form_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.field_rows(field_tree(spark, sf_dir))


def form_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns are fields; assistant turns update those of their number, the first one of a name counts."""
    fields = turns(spark, sf_dir, "user").select("doc_id", F.concat(F.lit("f"), F.col("n") % 4).alias("name"), F.col("text").alias("value"), (F.col("n") * 2).cast("int").alias("flags"), F.col("n").alias("ord"))
    updates = turns(spark, sf_dir, "assistant").select("doc_id", F.concat(F.lit("f"), F.col("n") % 3).alias("name"), F.col("n").alias("ord"), F.concat(F.lit("new "), F.col("n")).alias("value"))
    return forms.fill(fields, updates, flatten=True)


def xfdf_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = turns(spark, sf_dir, "user").select("doc_id", F.concat(F.lit("f&"), "n").alias("name"), F.concat(F.lit("<a> "), "text").alias("value"), F.col("n").alias("ord"))
    return forms.to_xfdf(fields)


def xfdf_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.from_xfdf(xfdf_export(spark, sf_dir))


def permissions_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    rights = forms.permissions((F.col("event_id") * 37 % 8192).cast("long"), (F.col("user_id") % 4 + 1).cast("int"), F.col("event_type") != "view")
    return rows.select("event_id", rights.alias("r")).select("event_id", "r.*")


def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made of the documents' first lines, every kind among them."""
    words = ("wrong Password", "access is denied", "corrupt stream", "No such file", "disk full", "timed out", "")
    text = F.concat(F.lit("Error:  "), _pick(words, F.col("doc_id")), F.lit("  "), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("message"))
    return rows.select("doc_id", scalar.error_kind(F.col("message")).alias("kind"), scalar.error_text(F.col("message")).alias("shown"))


def fuzzy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by how well their name or, half as well, their type meets a query."""
    rows = table(spark, sf_dir, "part")
    score = F.greatest(scalar.fuzzy_score(F.col("p_name"), "red") * 1.0, scalar.fuzzy_score(F.col("p_type"), "small") * 0.5)
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey"))
    return rows.select("p_partkey", "p_brand", score.alias("score")).filter("score > 0").withColumn("rank", rank)


QUERIES = {f.__name__: f for f in (comments_saved, comment_load_merge, comment_sync_actions, comments_in_flight, comments_open, annotation_filter, annotation_csv, popup_link, links_extract, link_scheme, page_links, links_edited, redact_overlap, region_hits, redacted_glyphs, redacted_annotations, redacted_info, anonymize_report, upper_median, heading_detect, outline_nest, form_fields, form_fill, xfdf_export, xfdf_roundtrip, permissions_bits, error_classify, fuzzy_rank)}

TURNS = """turns AS (SELECT conv_id AS doc_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n, text FROM conversations)"""
PALETTE = "['#f59e0b', '#10B981', '#3b82f6']"
NOTES = f"""{TURNS}, notes AS (SELECT doc_id, 'c' || n AS id, text, CASE WHEN n % 2 = 0 THEN {PALETTE}[doc_id % 3 + 1] END AS color, CASE WHEN n % 3 <> 0 THEN turn * 1000.0::DOUBLE END AS created, CASE WHEN n % 6 <> 0 THEN turn * 2000.0::DOUBLE END AS modified FROM turns WHERE role = 'user'),
stored AS (SELECT doc_id, 'c' || n AS id, CASE WHEN n % 5 = 0 THEN text ELSE 'stored ' || n END AS text, {PALETTE}[n % 3 + 1] AS color, n % 2 = 1 AS resolved, CASE WHEN n % 3 = 1 THEN turn * 10.0::DOUBLE END AS created_at, text AS quote, doc_id % 2 = 0 AS synced, n % 9 AS page FROM turns WHERE role = 'assistant' AND length(text) > 150)"""
ANNOTS = f"""a AS (SELECT conv_id AS doc_id, CAST(turn // 4 + 1 AS INTEGER) AS page, turn AS ord, turn AS id, ['Text', 'Highlight', 'Square', 'Popup', 'Widget', 'Link'][turn % 6 + 1] AS subtype,
  CASE WHEN turn % 3 = 0 THEN {PALETTE}[conv_id % 3 + 1] END AS color, CASE WHEN turn % 5 <> 4 THEN text || CASE WHEN turn % 2 = 0 THEN ' "q"' ELSE '' END END AS contents, turn - 3 AS parent,
  round((conv_id * 3 + turn) % 100 / 100.0::DOUBLE, 4) AS x0, round((conv_id * 5 + turn) % 100 / 100.0::DOUBLE, 4) AS y0, round((conv_id * 7 + turn) % 100 / 100.0::DOUBLE, 4) AS x1, round((conv_id * 11 + turn) % 100 / 100.0::DOUBLE, 4) AS y1 FROM conversations)"""
REGIONS = """r AS (SELECT doc_id, page, 10 + 100 * least(x0, x1) AS x0, 50 * least(y0, y1) AS y0, 10 + 100 * greatest(x0, x1) AS x1, 50 * greatest(y0, y1) AS y1 FROM a WHERE subtype = 'Square' AND doc_id % 2 = 1)"""
KNOWN = "subtype IN ('Text', 'Highlight', 'Square')"
LINKS = """links AS (SELECT page_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS ord, unnest(u) AS uri FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS u FROM pages))"""
HEIGHTS = """h AS (SELECT doc_id, CAST(k // 4 + 1 AS INTEGER) AS page, CAST(k % 4 AS INTEGER) AS ord, text, CASE WHEN length(text) < 12 THEN 20.0 WHEN length(text) < 30 THEN 16.0 WHEN length(text) < 60 THEN 13.5 WHEN length(text) < 100 THEN 12.5 ELSE 10.0 END::DOUBLE AS base, base + 0.25 * (k % 4 % 2)::DOUBLE AS height
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents)),
heads AS (SELECT h.doc_id, page, ord, trim(text) AS title, base, height FROM h JOIN (SELECT doc_id, list_sort(list(height))[len(list(height)) // 2 + 1] AS median FROM h WHERE page <= 500 AND strlen(trim(text)) >= 2 GROUP BY doc_id) m USING (doc_id)
  WHERE page <= 500 AND strlen(trim(text)) BETWEEN 2 AND 200 AND height >= median * 1.25)"""
BIT = "(event_id * 37 % 8192 & {}) <> 0"
MESSAGE = "regexp_replace(regexp_replace('Error:  ' || ['wrong Password', 'access is denied', 'corrupt stream', 'No such file', 'disk full', 'timed out', ''][doc_id % 7 + 1] || '  ' || text, '^Error:\\s*', '', 'i'), '\\s+', ' ', 'g')"
FORM = """f AS (SELECT conv_id AS doc_id, turn AS id, CASE WHEN turn > 0 THEN (turn - 1) // 2 END AS parent, 'f' || turn AS part, CASE WHEN turn = 0 OR turn % 4 = 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'Tx' ELSE 'Btn' END END AS field_type, CASE WHEN turn % 3 = 0 THEN text END AS value FROM conversations)"""
_RAW = "['wrong Password', 'access is denied', 'corrupt stream', 'No such file', 'disk full', 'timed out', ''][doc_id % 7 + 1] || '  ' || text"
ORACLES = {
    "comment_load_merge": f"WITH {NOTES} SELECT doc_id, id, CASE WHEN n.doc_id IS NOT NULL THEN coalesce(n.text, '') ELSE s.text END AS text, coalesce(n.color, s.color, '#f59e0b') AS color, coalesce(resolved, false) AS resolved, coalesce(created_at, created, modified, 0) AS created_at, quote, n.doc_id IS NOT NULL AS synced FROM notes n FULL JOIN stored s USING (doc_id, id) WHERE n.doc_id IS NOT NULL OR NOT synced",
    "comment_sync_actions": f"WITH {NOTES} SELECT doc_id, id, CASE WHEN s.doc_id IS NULL THEN 'delete' WHEN n.doc_id IS NOT NULL AND (n.text <> s.text OR lower(coalesce(n.color, '')) <> lower(s.color)) THEN 'update' WHEN n.doc_id IS NOT NULL THEN 'keep' WHEN page <= 5 THEN 'insert' ELSE 'skip' END AS action FROM notes n FULL JOIN stored s USING (doc_id, id)",
    "comments_saved": f"""WITH {NOTES} SELECT doc_id, id, CASE WHEN n.doc_id IS NOT NULL AND n.text = s.text AND lower(coalesce(n.color, '')) = lower(s.color) THEN n.text ELSE s.text END AS text,
      CASE WHEN n.doc_id IS NOT NULL AND n.text = s.text AND lower(coalesce(n.color, '')) = lower(s.color) THEN n.color ELSE s.color END AS color
      FROM notes n RIGHT JOIN stored s USING (doc_id, id) WHERE n.doc_id IS NOT NULL OR page <= 5""",
    "comments_in_flight": f"WITH {NOTES} SELECT doc_id, id, text FROM notes UNION ALL SELECT doc_id, id, text FROM stored WHERE (doc_id, id) NOT IN (SELECT (doc_id, id) FROM notes)",
    "comments_open": f"WITH {NOTES} SELECT doc_id, count(*) FILTER (WHERE NOT resolved) AS open, count(*) FILTER (WHERE resolved) AS resolved FROM stored GROUP BY doc_id",
    "annotation_filter": f"WITH {ANNOTS} SELECT doc_id, page, ord, subtype, color FROM a WHERE {KNOWN}",
    "annotation_csv": f"""WITH {ANNOTS} SELECT doc_id, page, ord, page || ',' || subtype || ',' || coalesce(color, '') || ',' || CASE WHEN regexp_matches(coalesce(contents, ''), '[,"\\n\\r]') THEN '"' || replace(contents, '"', '""') || '"' ELSE coalesce(contents, '') END || printf(',%.4f,%.4f,%.4f,%.4f', x0, y0, x1, y1) AS line FROM a WHERE {KNOWN}""",
    "popup_link": f"WITH {ANNOTS} SELECT n.doc_id, n.id, p.id AS popup_id FROM a n LEFT JOIN (SELECT * FROM a WHERE subtype = 'Popup') p ON p.doc_id = n.doc_id AND p.parent = n.id WHERE n.subtype = 'Text'",
    "links_extract": f"WITH {LINKS} SELECT * FROM links WHERE uri <> ''",
    "link_scheme": f"WITH {LINKS} SELECT page_id, count(*) FILTER (WHERE regexp_matches(uri, '(?i)^(https?|mailto):')) AS outside, count(*) AS links FROM (SELECT page_id, uri FROM links WHERE uri <> '' UNION ALL SELECT page_id, url FROM pages) GROUP BY page_id",
    "page_links": f"WITH {LINKS} SELECT page_id AS doc_id, CAST(1 AS INTEGER) AS page, ord, CASE WHEN ord % 3 <> 0 THEN uri END AS uri, CAST(CASE WHEN ord % 2 = 0 THEN ord + 1 END AS INTEGER) AS dest_page FROM links WHERE uri <> '' AND (ord % 3 <> 0 OR ord % 2 = 0)",
    "links_edited": f"WITH {LINKS} SELECT doc_id, CAST(1 AS INTEGER) AS page, CAST(ord AS INTEGER) AS ord, uri, CAST(dest_page AS INTEGER) AS dest_page FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM (SELECT page_id AS doc_id, ord, uri, NULL AS dest_page FROM links WHERE uri <> '' UNION ALL SELECT page_id, max(ord) + 1, CASE WHEN page_id % 3 = 0 THEN 'https://example.org' END, CASE WHEN page_id % 3 = 1 THEN 4 END FROM links WHERE uri <> '' AND page_id % 3 <> 2 GROUP BY page_id)) WHERE i <> 2",
    "redact_overlap": f"WITH {ANNOTS}, b AS (SELECT doc_id, page, ord, subtype, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1) AS x1, greatest(y0, y1) AS y1 FROM a) SELECT doc_id, page, ord FROM b c WHERE NOT EXISTS (SELECT 1 FROM b r WHERE r.subtype = 'Square' AND r.doc_id = c.doc_id AND r.page = c.page AND c.x0 < r.x1 AND c.x1 > r.x0 AND c.y0 < r.y1 AND c.y1 > r.y0)",
    "region_hits": f"WITH {ANNOTS}, b AS (SELECT doc_id, page, ord, subtype, least(x0, x1) AS x0, least(y0, y1) AS y0, greatest(x0, x1) AS x1, greatest(y0, y1) AS y1 FROM a) SELECT c.doc_id, c.page, c.ord, r.ord AS square FROM b c JOIN b r ON r.subtype = 'Square' AND r.doc_id = c.doc_id AND c.x0 < r.x1 AND c.x1 > r.x0 AND c.y0 < r.y1 AND c.y1 > r.y0",
    "redacted_glyphs": f"WITH {ANNOTS}, {REGIONS} SELECT doc_id, page, ord FROM a c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = c.doc_id AND r.page = c.page AND least(c.x0, c.x1) * 100 < r.x1 AND greatest(c.x0, c.x1) * 100 > r.x0 AND least(c.y0, c.y1) * 100 < r.y1 AND greatest(c.y0, c.y1) * 100 > r.y0)",
    "redacted_annotations": f"WITH {ANNOTS}, {REGIONS} SELECT doc_id, page, ord, subtype FROM a WHERE subtype NOT IN ('Text', 'Highlight', 'Popup') OR (doc_id, page) NOT IN (SELECT (doc_id, page) FROM r)",
    "redacted_info": f"WITH {ANNOTS} SELECT DISTINCT doc_id, key FROM a, (VALUES ('Title'), ('Author'), ('Producer')) k(key) WHERE key = 'Producer' OR doc_id NOT IN (SELECT doc_id FROM a WHERE doc_id % 5 = 0 OR doc_id % 2 = 1 AND subtype = 'Square')",
    "anonymize_report": "SELECT doc_id, category, count(*) AS removed FROM (SELECT user_id AS doc_id, CASE WHEN s = 'info' AND k IN ('Title', 'Author') THEN 'info' WHEN s = 'catalog' AND k = 'Names' THEN 'names' WHEN s = 'catalog' AND k = 'OpenAction' THEN 'open_action' WHEN s = 'catalog' AND k = 'AA' THEN 'additional_actions' WHEN s = 'annotation' AND k = 'T' THEN 'authors' END AS category FROM (SELECT user_id, ['info', 'catalog', 'annotation'][event_id % 3 + 1] AS s, ['Title', 'Author', 'Metadata', 'Names', 'OpenAction', 'AA', 'T', 'NM', 'Other'][event_id // 3 % 9 + 1] AS k FROM events)) WHERE category IS NOT NULL GROUP BY ALL",
    "upper_median": f"WITH {HEIGHTS} SELECT doc_id, list_sort(list(height))[len(list(height)) // 2 + 1] AS median FROM h GROUP BY doc_id",
    "heading_detect": f"WITH {HEIGHTS} SELECT doc_id, page, ord, title, height FROM heads",
    "outline_nest": f"""WITH {HEIGHTS}, t AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY base DESC) - 1 AS r, row_number() OVER (PARTITION BY doc_id ORDER BY page, ord) AS n FROM heads),
      u AS (SELECT *, least(r, 2) AS tier, min(CASE WHEN r <= 1 THEN n END) OVER (PARTITION BY doc_id) AS first_top FROM t),
      v AS (SELECT *, tier = 0 OR (tier = 1 AND n = first_top) AS leads FROM u),
      w AS (SELECT *, max(CASE WHEN leads THEN n END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h1, coalesce(max(CASE WHEN leads THEN n END) OVER (PARTITION BY doc_id ORDER BY n), 0) AS island FROM v),
      x AS (SELECT *, max(CASE WHEN tier = 1 AND NOT leads THEN n END) OVER (PARTITION BY doc_id, island ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h2 FROM w)
      SELECT doc_id, CAST(n AS INTEGER) AS n, CAST(CASE WHEN leads OR (h1 IS NULL AND h2 IS NULL) THEN 0 WHEN tier = 1 OR h2 IS NULL THEN 1 ELSE 2 END AS INTEGER) AS depth, CAST(CASE WHEN leads THEN NULL WHEN tier = 1 THEN h1 ELSE coalesce(h2, h1) END AS INTEGER) AS parent_n, title, page FROM x""",
    "form_fields": f"WITH RECURSIVE {FORM}, w AS (SELECT doc_id, id, part AS name, field_type, value FROM f WHERE parent IS NULL UNION ALL SELECT f.doc_id, f.id, w.name || '.' || f.part, coalesce(f.field_type, w.field_type), coalesce(f.value, w.value) FROM w JOIN f ON f.doc_id = w.doc_id AND f.parent = w.id) SELECT doc_id, id, name, field_type, value FROM w WHERE (doc_id, id) NOT IN (SELECT (doc_id, parent) FROM f WHERE parent IS NOT NULL)",
    "form_fill": f"WITH {TURNS}, u AS (SELECT doc_id, 'f' || n % 3 AS name, arg_min('new ' || n, n) AS v FROM turns WHERE role = 'assistant' GROUP BY 1, 2) SELECT t.doc_id, 'f' || n % 4 AS name, coalesce(v, text) AS value, CAST(n * 2 + 1 AS INTEGER) AS flags, CAST(n AS INTEGER) AS ord FROM turns t LEFT JOIN u ON u.doc_id = t.doc_id AND u.name = 'f' || n % 4 WHERE role = 'user'",
    "xfdf_export": f"""WITH {TURNS} SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<xfdf xmlns="http://ns.adobe.com/xfdf/" xml:space="preserve">' || chr(10) || '  <fields>' || chr(10) || string_agg('    <field name="f&amp;' || n || '"><value>&lt;a&gt; ' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</value></field>' || chr(10), '' ORDER BY n) || '  </fields>' || chr(10) || '</xfdf>' || chr(10) AS xfdf FROM turns WHERE role = 'user' GROUP BY doc_id""",
    "xfdf_roundtrip": f"WITH {TURNS} SELECT doc_id, CAST(n - 1 AS INTEGER) AS ord, 'f&' || n AS name, '<a> ' || text AS value FROM turns WHERE role = 'user'",
    "permissions_bits": "SELECT event_id, " + ", ".join(f"event_type = 'view' OR CASE WHEN user_id % 4 + 1 >= 3 THEN {BIT.format(1 << new - 1)} ELSE {BIT.format(1 << old - 1)} END AS {name}" for name, new, old in (("print", 3, 3), ("modify_contents", 4, 4), ("copy_extract", 5, 5), ("annotate", 6, 6), ("fill_forms", 9, 6), ("accessibility_extract", 10, 5), ("assemble", 11, 4), ("print_high_quality", 12, 3))) + " FROM events",
    "error_classify": "SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches({_RAW}, '{p}') THEN '{n}'" for p, n in scalar.ERROR_KINDS) + f" ELSE 'other' END AS kind, CASE WHEN length(trim({MESSAGE})) > 280 THEN substr(trim({MESSAGE}), 1, 280) || '…' ELSE trim({MESSAGE}) END AS shown FROM documents",
    "fuzzy_rank": "SELECT p_partkey, p_brand, score, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS INTEGER) AS rank FROM (SELECT p_partkey, p_brand, greatest(CASE WHEN lower(p_name) = 'red' THEN 1000.0 WHEN starts_with(lower(p_name), 'red') THEN 500.0 WHEN contains(lower(p_name), 'red') THEN 200.0 WHEN regexp_matches(lower(p_name), '(?s)r.*e.*d') THEN 50.0 ELSE 0.0 END, 0.5 * CASE WHEN lower(p_type) = 'small' THEN 1000 WHEN starts_with(lower(p_type), 'small') THEN 500 WHEN contains(lower(p_type), 'small') THEN 200 WHEN regexp_matches(lower(p_type), '(?s)s.*m.*a.*l.*l') THEN 50 ELSE 0 END)::DOUBLE AS score FROM part) WHERE score > 0",
}
