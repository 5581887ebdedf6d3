"""Queries on texts and page sequences over the documents table, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.operators import labels, sequence, text
from pageloom.sources.tables import table

TERM = "the"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.pages_of(docs(spark, sf_dir))


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search_pages(pages(spark, sf_dir), TERM)


def search_hits_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search_hits(pages(spark, sf_dir), TERM)


def overlap_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search_highlights(pages(spark, sf_dir), "ana")


def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.page_counts(pages(spark, sf_dir))


def doc_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page count and size of each document, with its labels where it has any."""
    counts = text.page_counts(pages(spark, sf_dir))
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("file_size"), "lang", "source")
    info = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return counts.join(sizes, "doc_id").join(info, "doc_id", "left")


def export_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.export_text(docs(spark, sf_dir))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text.clean_lines(text.lines_of(docs(spark, sf_dir)))
    return lines.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.max(F.length("text")).cast("long").alias("longest"))


def broken_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pipes and signs that junk is padded with count as broken marks."""
    return text.broken_pages(pages(spark, sf_dir), "|%#$&*!�□◇", 5)


def compare_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document beside the one with the next id, pages 2k and 2k + 1 being a pair."""
    halves = pages(spark, sf_dir).withColumn("pair_id", F.floor(F.col("doc_id") / 2))
    both = text.compare_pages(halves.filter("doc_id % 2 = 0"), halves.filter("doc_id % 2 = 1"))
    return both.select("pair_id", "page", F.length("left_text").alias("left_length"), F.length("right_text").alias("right_length"), "equal")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("total"))


def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document into its first half, and a part that overlaps it and runs past the end."""
    half = totals(spark, sf_dir).withColumn("half", F.ceil(F.col("total") / 2).cast("int"))
    first = half.select("doc_id", F.lit(1).alias("part"), F.lit(0).alias("start"), F.col("half").alias("stop"))
    second = half.select("doc_id", F.lit(2).alias("part"), F.col("half").alias("start"), (F.col("total") + 5).alias("stop"))
    return sequence.split_ranges(pages(spark, sf_dir), first.unionByName(second))


def range_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = totals(spark, sf_dir).select("doc_id", F.lit(1).alias("part"), F.lit(3).alias("start"), F.lit(9).alias("stop"))
    return sequence.range_errors(pages(spark, sf_dir), asked)


def split_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.split_per_page(pages(spark, sf_dir))


def split_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.split_every(pages(spark, sf_dir), 3)


def split_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line of every third page, from the second one on, as bookmarks; some pages have two."""
    lines = text.lines_of(docs(spark, sf_dir)).filter("line < 2 and page % 3 = 2")
    marks = lines.select("doc_id", F.col("line").alias("ord"), F.col("text").alias("title"), "page")
    return sequence.split_at_bookmarks(totals(spark, sf_dir), marks)


def merge_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each language and source become one."""
    order = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("merged_id"), F.col("doc_id").alias("ord"), "doc_id")
    return sequence.merge_sequences(pages(spark, sf_dir), order)


def remove_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = pages(spark, sf_dir).select("doc_id", "page")
    return sequence.remove_pages(every, every.filter("page % 2 = 0"))


def removal_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = pages(spark, sf_dir).select("doc_id", "page")
    return sequence.removal_errors(every, every.filter("page <= 2"))


def reorder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages backwards; documents of five pages or more get an order that is none, and stay."""
    order = F.when(F.col("total") < 5, F.reverse(F.sequence(F.lit(1), F.col("total")))).otherwise(F.array(F.lit(1), F.lit(1)))
    return sequence.reorder_pages(pages(spark, sf_dir), totals(spark, sf_dir).select("doc_id", order.alias("new_order")))


def interleave_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three notes a document: before all pages, after the second, and far past the end."""
    spots = F.posexplode(F.array(F.lit(2), F.lit(0), F.lit(99))).alias("ord", "after")
    return sequence.interleave(pages(spark, sf_dir), totals(spark, sf_dir).select("doc_id", spots))


def move_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page before the second, in even documents; the first page to the end in odd ones."""
    even = F.col("doc_id") % 2 == 0
    moves = totals(spark, sf_dir).select("doc_id", F.when(even, F.col("total")).otherwise(1).alias("source"), F.when(even, 2).alias("target"))
    return sequence.move_page(pages(spark, sf_dir), moves)


def page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of pages for every document, made of its id and total, with faulty parts."""
    wanted = F.concat(F.lit("3, 1-2,x,"), (F.col("doc_id") % 7).cast("string"), F.lit(",4-"), F.col("total").cast("string"), F.lit(", 2 ,0,9-8"))
    return totals(spark, sf_dir).select("doc_id", "total", wanted.alias("wanted"))


def page_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_lists(spark, sf_dir)
    return found.select("doc_id", F.explode(sequence.parse_pages(F.col("wanted"), F.col("total"))).alias("page"))


def page_list_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.format_pages(page_list_parse(spark, sf_dir), "doc_id")


def page_list_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_lists(spark, sf_dir)
    spans = found.select("doc_id", F.posexplode(sequence.parse_ranges(F.col("wanted"), F.col("total"))).alias("at", "span"))
    return spans.select("doc_id", (F.col("at") + 1).alias("part"), "span.start", "span.stop")


def bates_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.stamp_numbers(pages(spark, sf_dir), labels.Numbering("CASE-", "-A", 9998, 1, 4))


def bates_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.stamp_report(bates_labels(spark, sf_dir))


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.page_numbers(pages(spark, sf_dir), 100)


def header_footer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names are the sources; one of them holds a field itself."""
    name = F.when(F.col("source") == "src1", "{date}.pdf").otherwise(F.concat(F.col("source"), F.lit(".pdf")))
    files = table(spark, sf_dir, "documents").select("doc_id", name.alias("filename"))
    return labels.header_footer(pages(spark, sf_dir), files, "{filename} — page {page}/{total} {date}", "2024-02-29", 2)


def overlay_add_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content rows per page after a stamp below, one above, and taking the first off again."""
    lines = text.lines_of(docs(spark, sf_dir))
    contents = lines.select("doc_id", "page", F.col("line").alias("ord"), F.lit(None).cast("string").alias("tag"), "text")
    stamped = labels.add_overlay(contents, bates_labels(spark, sf_dir), "bates")
    stamped = labels.add_overlay(stamped, page_numbers(spark, sf_dir), "numbers", on_top=True)
    left = labels.remove_overlay(stamped, "bates")
    return left.groupBy("doc_id", "page").agg(F.count("*").alias("rows"), F.min("ord").alias("low"), F.max_by("text", "ord").alias("top"))


PAGES = r"""
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents
), pages AS (
  SELECT doc_id, CAST(k // 4 + 1 AS INTEGER) AS page, string_agg(text, chr(10) ORDER BY k) || chr(10) AS text FROM lines GROUP BY doc_id, k // 4 + 1
), totals AS (
  SELECT doc_id, max(page) AS total FROM pages GROUP BY doc_id
)"""
LISTS = r""", asked AS (
  SELECT doc_id, total, string_split('3, 1-2,x,' || (doc_id % 7) || ',4-' || total || ', 2 ,0,9-8', ',') AS parts FROM totals
), parts AS (
  SELECT doc_id, total, trim(unnest(parts)) AS part, generate_subscripts(parts, 1) AS k FROM asked
), spans AS (
  SELECT doc_id, k, TRY_CAST(regexp_extract(part, '^([0-9]+)(-([0-9]+))?$', 1) AS BIGINT) AS start,
         TRY_CAST(CASE WHEN contains(part, '-') THEN regexp_extract(part, '^([0-9]+)-([0-9]+)$', 2) ELSE part END AS BIGINT) AS stop, total
  FROM parts WHERE regexp_matches(part, '^[0-9]+(-[0-9]+)?$')
), fit AS (SELECT * FROM spans WHERE start >= 1 AND stop >= start AND stop <= total)"""
STAMPS = "SELECT doc_id, page, 'CASE-' || printf('%04d', 9998 + row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1) || '-A' AS label FROM pages"

QUERIES = {f.__name__: f for f in (search_pages, search_hits_expanded, overlap_hits, page_count, doc_info, export_text, text_lines, broken_blocks, compare_pages, split_ranges, range_errors, split_per_page, split_every_n, split_bookmarks, merge_docs, remove_pages, removal_errors, reorder_pages, interleave_pages, move_page, page_list_parse, page_list_format, page_list_ranges, bates_labels, bates_report, page_numbers, header_footer, overlay_add_remove)}

_SQL = {
    "search_pages": "SELECT doc_id, page, CAST((length(text) - length(replace(lower(text), 'the', ''))) // 3 AS BIGINT) AS count FROM pages WHERE contains(lower(text), 'the')",
    "search_hits_expanded": "SELECT doc_id, page, CAST(unnest(range(1, (length(text) - length(replace(lower(text), 'the', ''))) // 3 + 1)) AS INTEGER) AS ordinal FROM pages WHERE contains(lower(text), 'the')",
    "overlap_hits": "SELECT doc_id, page, CAST(len(list_filter(range(1, length(text) - 1), lambda i: lower(text)[i:i + 2] = 'ana')) AS BIGINT) AS count FROM pages WHERE contains(lower(text), 'ana')",
    "page_count": "SELECT doc_id, count(*) AS page_count FROM pages GROUP BY doc_id",
    "doc_info": "SELECT d.doc_id, (SELECT count(*) FROM pages p WHERE p.doc_id = d.doc_id) AS page_count, strlen(text) AS file_size, lang, source, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)",
    "export_text": "SELECT doc_id, string_agg('--- Page ' || page || ' ---' || chr(10) || text || chr(10), '' ORDER BY page) AS body FROM pages GROUP BY doc_id",
    "text_lines": "SELECT doc_id, CAST(k // 4 + 1 AS INTEGER) AS page, count(*) AS lines, max(length(regexp_replace(text, '[\\x00-\\x08\\x0A-\\x1F]', '', 'g'))) AS longest FROM lines GROUP BY doc_id, k // 4 + 1",
    "broken_blocks": "SELECT doc_id, page, CAST(length(regexp_replace(text, '[^|%#$&*!�□◇]', '', 'g')) * 100 // length(text) AS BIGINT) AS percent, length(regexp_replace(text, '[^|%#$&*!�□◇]', '', 'g')) * 100 // length(text) >= 5 AS broken FROM pages",
    "compare_pages": "SELECT coalesce(a.doc_id, b.doc_id) // 2 AS pair_id, coalesce(a.page, b.page) AS page, CAST(length(a.text) AS INTEGER) AS left_length, CAST(length(b.text) AS INTEGER) AS right_length, coalesce(a.text = b.text, false) AS equal FROM (SELECT * FROM pages WHERE doc_id % 2 = 0) a FULL JOIN (SELECT * FROM pages WHERE doc_id % 2 = 1) b ON a.doc_id // 2 = b.doc_id // 2 AND a.page = b.page",
    "split_ranges": "SELECT t.doc_id, part, CAST(page - lo + 1 AS INTEGER) AS position, page FROM (SELECT doc_id, 1 AS part, 1 AS lo, (total + 1) // 2 AS hi FROM totals UNION ALL SELECT doc_id, 2, (total + 1) // 2, total FROM totals) t JOIN pages p ON p.doc_id = t.doc_id AND page BETWEEN lo AND hi",
    "range_errors": "SELECT doc_id, 1 AS part, CAST(3 AS BIGINT) AS start, CAST(least(9, total) AS BIGINT) AS stop FROM totals WHERE total < 3",
    "split_per_page": "SELECT doc_id, page, '_page' || printf('%04d', page) AS label FROM pages",
    "split_every_n": "SELECT doc_id, CAST((page - 1) // 3 + 1 AS INTEGER) AS part, page AS start, least(page + 2, total) AS stop FROM pages JOIN totals USING (doc_id) WHERE page % 3 = 1",
    "split_bookmarks": r"""SELECT doc_id, CAST(row_number() OVER w AS INTEGER) AS part,
        CASE WHEN trim(regexp_replace(title, '[^\p{L}\p{N} \-]', '_', 'g')) = '' THEN 'part' || row_number() OVER w ELSE trim(regexp_replace(title, '[^\p{L}\p{N} \-]', '_', 'g')) END AS label,
        page AS start, CAST(coalesce(lead(page) OVER w - 1, total) AS INTEGER) AS stop
        FROM (SELECT doc_id, CAST(k // 4 + 1 AS INTEGER) AS page, text AS title FROM lines WHERE k % 4 = 0 AND (k // 4 + 1) % 3 = 2) m JOIN totals USING (doc_id)
        WINDOW w AS (PARTITION BY doc_id ORDER BY page)""",
    "merge_docs": "SELECT lang || '/' || source AS merged_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id, page) AS position, doc_id, page FROM pages JOIN documents USING (doc_id)",
    "remove_pages": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page) AS INTEGER) AS page, page AS old_page FROM pages WHERE page % 2 = 1",
    "removal_errors": "SELECT doc_id, 'no page would be left' AS message FROM totals WHERE total <= 2",
    "reorder_pages": "SELECT doc_id, page, CASE WHEN total < 5 THEN total + 1 - page ELSE page END AS old_page FROM pages JOIN totals USING (doc_id)",
    "interleave_pages": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY anchor, new, ord) AS INTEGER) AS page, CASE WHEN new = 1 THEN 'inserted' ELSE 'own' END AS source, old FROM (SELECT doc_id, page AS anchor, 0 AS new, 0 AS ord, page AS old FROM pages UNION ALL SELECT doc_id, least(unnest([2, 0, 99]), total), 1, unnest([0, 1, 2]), unnest([0, 1, 2]) FROM totals) u",
    "move_page": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN doc_id % 2 = 0 AND page = total THEN 1.5 WHEN doc_id % 2 = 1 AND page = 1 THEN 1e9 ELSE page END, page) AS INTEGER) AS page, page AS old_page FROM pages JOIN totals USING (doc_id)",
    "page_list_parse": "SELECT DISTINCT doc_id, unnest(generate_series(start, stop)) AS page FROM fit",
    "page_list_format": "SELECT doc_id, string_agg(CASE WHEN low = high THEN low::VARCHAR ELSE low || '-' || high END, ', ' ORDER BY low) AS pages FROM (SELECT doc_id, min(page) AS low, max(page) AS high FROM (SELECT doc_id, page, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS island FROM (SELECT DISTINCT doc_id, unnest(generate_series(start, stop)) AS page FROM fit)) GROUP BY doc_id, island) GROUP BY doc_id",
    "page_list_ranges": "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INTEGER) AS part, start, stop FROM fit",
    "bates_labels": STAMPS,
    "bates_report": f"SELECT doc_id, min_by(label, page) AS first_label, max_by(label, page) AS last_label, count(*) AS pages FROM ({STAMPS}) GROUP BY doc_id",
    "page_numbers": "SELECT doc_id, page, CAST(100 + row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS VARCHAR) AS label FROM pages",
    "header_footer": "SELECT doc_id, page, CASE WHEN source = 'src1' THEN '2024-02-29.pdf' ELSE source || '.pdf' END || ' — page ' || page || '/' || total || ' 2024-02-29' AS text FROM pages JOIN totals USING (doc_id) JOIN documents USING (doc_id) WHERE page >= 2",
    "overlay_add_remove": "SELECT doc_id, CAST(k // 4 + 1 AS INTEGER) AS page, count(*) + 1 AS rows, CAST(0 AS INTEGER) AS low, CAST(99 + k // 4 + 1 AS VARCHAR) AS top FROM lines GROUP BY doc_id, k // 4",
}
ORACLES = {name: f"WITH {PAGES}{LISTS if name.startswith('page_list') else ''}\n{sql}" for name, sql in _SQL.items()}
