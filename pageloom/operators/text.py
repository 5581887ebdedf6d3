"""Lines, pages, search and text export. Pages come out of a document's text in place: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES_PER_PAGE = 4


def lines_of(docs: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """(doc_id, page, line, text): the lines of each text, ``per_page`` to a page; pages and lines count from 1 and 0."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "text"))
    return lines.select("doc_id", (F.floor(F.col("at") / per_page) + 1).cast("int").alias("page"), (F.col("at") % per_page).alias("line"), "text")


def pages_of(docs: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """(doc_id, page, text): lines joined by line feeds, each ending in one."""
    lines = docs.select("doc_id", F.split("text", "\n", -1).alias("lines"))
    starts = F.sequence(F.lit(0), F.ceil(F.size("lines") / per_page).cast("int") - 1)
    text = F.transform(starts, lambda i: F.concat(F.array_join(F.slice("lines", i * per_page + 1, per_page), "\n"), F.lit("\n")))
    return lines.filter(F.col("lines").isNotNull()).select("doc_id", F.posexplode(text).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("page"), "text")


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))


def occurrences(text: Column, query: str) -> Column:
    """How often a term occurs in a text in any case, matches not overlapping; an empty term never."""
    if not query:
        return F.lit(0).cast("long")
    lower = F.lower(text)
    rest = F.length(F.replace(lower, F.lit(query.lower()), F.lit("")))
    return ((F.length(lower) - rest) / len(query.lower())).cast("long")


def overlapping(text: Column, query: str) -> Column:
    """How often a term occurs when matches may overlap, as highlights are drawn: each place where one starts counts."""
    if not query:
        return F.lit(0).cast("long")
    literal = "".join(c if c.isalnum() or not c.isascii() else "\\" + c for c in query.lower())
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(f"(?={literal})")), F.lit(0)).cast("long")


def search_pages(pages: DataFrame, query: str) -> DataFrame:
    """(doc_id, page, count) of the pages that hold the term."""
    return pages.select("doc_id", "page", occurrences(F.col("text"), query).alias("count")).filter("count > 0")


def search_hits(pages: DataFrame, query: str) -> DataFrame:
    """One row a match, numbered within its page, in reading order."""
    hits = search_pages(pages, query)
    return hits.select("doc_id", "page", F.posexplode(F.array_repeat(F.col("page"), F.col("count").cast("int"))).alias("at", "p")).select("doc_id", "page", (F.col("at") + 1).alias("ordinal"))


def search_highlights(pages: DataFrame, query: str) -> DataFrame:
    return pages.select("doc_id", "page", overlapping(F.col("text"), query).alias("count")).filter("count > 0")


def export_text(docs: DataFrame, per_page: int = LINES_PER_PAGE) -> DataFrame:
    """(doc_id, body): every page under a ``--- Page n ---`` line, lines as they are, an empty line after each page."""
    lines = docs.filter("text is not null").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    starts = F.sequence(F.lit(0), F.ceil(F.size("lines") / per_page).cast("int") - 1)
    page = F.transform(starts, lambda i: F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), F.array_join(F.slice("lines", i * per_page + 1, per_page), "\n"), F.lit("\n\n")))
    return lines.select("doc_id", F.array_join(page, "").alias("body"))


def clean_lines(lines: DataFrame) -> DataFrame:
    """Lines without control characters but the tab, with the box around them left as it is."""
    return lines.withColumn("text", F.regexp_replace("text", r"[\x00-\x08\x0A-\x1F]", ""))


def broken_pages(pages: DataFrame, suspects: str = "\ufffd\u25a1\u25c7", limit: int = 20) -> DataFrame:
    """Pages with the share of suspect marks, boxes and the like, in whole per cents, and whether it reaches the limit."""
    total = F.length("text")
    marks = total - F.length(F.translate("text", suspects, ""))
    percent = F.when(total > 0, F.floor(marks * 100 / total)).otherwise(0).cast("long")
    return pages.select("doc_id", "page", percent.alias("percent"), (percent >= limit).alias("broken"))


def compare_pages(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pages of two documents side by side, by (pair_id, page); the side that has no such page is null."""
    a = left.select("pair_id", "page", F.col("text").alias("left_text"))
    b = right.select("pair_id", "page", F.col("text").alias("right_text"))
    both = a.join(b, ["pair_id", "page"], "full_outer")
    return both.select("pair_id", "page", "left_text", "right_text", F.coalesce(F.col("left_text") == F.col("right_text"), F.lit(False)).alias("equal"))


def line_boxes(chars: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, x0, y0, x1, y1) of characters (doc_id, page, line, pos, c, box): a line's text and the box round it."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda s: s["c"]), "")
    edges = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return chars.groupBy("doc_id", "page", "line").agg(text.alias("text"), *edges)
