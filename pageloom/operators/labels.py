"""Sequence labels: stamped numbers, page numbers, headers and footers, and overlays that can be taken off again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Numbering:
    prefix: str = ""
    suffix: str = ""
    start: int = 1
    increment: int = 1
    digits: int = 6


def number_label(n: Column, o: Numbering) -> Column:
    """prefix, the number with at least ``digits`` (1 to 12) digits and never fewer than it has, suffix."""
    return F.concat(F.lit(o.prefix), F.format_string(f"%0{min(max(o.digits, 1), 12)}d", n.cast("long")), F.lit(o.suffix))


def stamp_numbers(pages: DataFrame, o: Numbering = Numbering()) -> DataFrame:
    """(doc_id, page, label): the i-th page, from 0, gets start + i x max(increment, 1)."""
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return pages.select("doc_id", "page", number_label(o.start + i * max(o.increment, 1), o).alias("label"))


def stamp_report(stamped: DataFrame) -> DataFrame:
    """(doc_id, first_label, last_label, pages)."""
    return stamped.groupBy("doc_id").agg(F.min_by("label", "page").alias("first_label"), F.max_by("label", "page").alias("last_label"), F.count("*").alias("pages"))


def page_numbers(pages: DataFrame, start_at: int = 1) -> DataFrame:
    i = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    return pages.select("doc_id", "page", (start_at + i).cast("string").alias("label"))


def fill_template(template: Column, page: Column, total: Column, filename: Column, date: Column) -> Column:
    """{page}, {total}, {filename}, {date} replaced in this order, so a file name may itself hold {date}."""
    for key, value in (("{page}", page), ("{total}", total), ("{filename}", filename), ("{date}", date)):
        template = F.replace(template, F.lit(key), value.cast("string"))
    return template


def header_footer(pages: DataFrame, files: DataFrame, template: str, date: str | Column, first: int = 1, last: int | None = None) -> DataFrame:
    """(doc_id, page, text) for the pages in [first, last]; files: (doc_id, filename)."""
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("total")).join(files, "doc_id")
    inside = (F.col("page") >= first) & (F.col("page") <= (F.col("total") if last is None else F.lit(last)))
    text = fill_template(F.lit(template), F.col("page"), F.col("total"), F.col("filename"), F.lit(date) if isinstance(date, str) else date)
    return pages.select("doc_id", "page").join(totals, "doc_id").filter(inside).select("doc_id", "page", text.alias("text"))


def stamped_pages(stamps: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, stamped): how many pages of each file were stamped, 0 where none was."""
    counts = stamps.groupBy("doc_id").agg(F.count("*").alias("n"))
    return files.join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("stamped"))


def today(zone: str = "UTC") -> Column:
    """The date as YYYY-MM-DD, for templates: in UTC or a given zone, whatever the session's."""
    now = F.from_utc_timestamp(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), zone)
    return F.date_format(now, "yyyy-MM-dd")


def add_overlay(contents: DataFrame, stamps: DataFrame, tag: str, on_top: bool = False) -> DataFrame:
    """Content rows (doc_id, page, ord, tag, text) with tagged stamps (doc_id, page, label): before all content, or after it."""
    edge = contents.groupBy("doc_id", "page").agg((F.max("ord") + 1 if on_top else F.min("ord") - 1).alias("ord"))
    new = stamps.join(edge, ["doc_id", "page"]).select("doc_id", "page", "ord", F.lit(tag).alias("tag"), F.col("label").alias("text"))
    return contents.select("doc_id", "page", "ord", "tag", "text").unionByName(new)


def remove_overlay(contents: DataFrame, tag: str) -> DataFrame:
    return contents.filter(~F.col("tag").eqNullSafe(F.lit(tag)))


def anchor(position: Column, text: Column, width: Column, height: Column, size: float, margin: float) -> Column:
    """(x, y) of a stamp at one of six anchors; a text's width is taken as 0.6 x size a byte; any other name is bottom-right."""
    wide = F.octet_length(text) * size * 0.6
    known = position.rlike("^(top|bottom)-(left|center|right)$")
    x = F.when(known & position.endswith("left"), F.lit(margin)).when(known & position.endswith("center"), width / 2 - wide / 2).otherwise(width - margin - wide)
    y = F.when(known & position.startswith("top"), height - margin).otherwise(F.lit(margin))
    return F.struct(x.alias("x"), y.alias("y"))
