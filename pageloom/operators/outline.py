"""Headings from line heights, and outlines as rows with parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median): the middle value, of an even number the upper one. Values are counted first, so ties cost one row."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    window = Window.partitionBy(*keys)
    upto = counts.withColumn("upto", F.sum("n").over(window.orderBy(value))).withColumn("total", F.sum("n").over(window))
    return upto.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy(*keys).agg(F.min(value).alias("median"))


def headings(lines: DataFrame, factor: float = 1.25, most_pages: int = 500) -> DataFrame:
    """(doc_id, page, ord, title, height): lines of 2 to 200 bytes at least ``factor`` times as high as their document's upper median.

    lines: (doc_id, page, ord, text, height); pages past most_pages and lines of under two bytes count for nothing.
    """
    text = F.trim("text")
    usable = lines.filter((F.col("page") <= max(most_pages, 1)) & (F.octet_length(text) >= 2) & (F.col("height") > 0)).withColumn("title", text)
    median = upper_median(usable, ["doc_id"], "height")
    tall = usable.join(median, "doc_id").filter((F.col("height") >= F.col("median") * factor) & (F.octet_length("title") <= 200))
    return tall.select("doc_id", "page", "ord", "title", "height")


def tiers(heights: Column) -> Column:
    """Up to three sizes, from an array of heights: the largest first, each at least 0.5 below the one kept before."""
    down = F.reverse(F.array_sort(F.array_distinct(heights)))
    kept = F.aggregate(down, F.array().cast("array<double>"), lambda a, h: F.when((F.size(a) == 0) | (F.abs(F.try_element_at(a, F.lit(-1)) - h) >= 0.5), F.concat(a, F.array(h))).otherwise(a))
    return F.slice(kept, 1, 3)


def nest(found: DataFrame) -> DataFrame:
    """(doc_id, n, depth, parent_n, title, page): headings nested by size: the first tier within 0.6, else the last.

    A second-tier heading goes under the last first-tier one, or stands at the top and takes its place if there is none
    yet; a third-tier one under the last second-tier one since, else under the last first-tier one, else at the top.
    """
    order = Window.partitionBy("doc_id").orderBy("page", "ord")
    sizes = found.groupBy("doc_id").agg(tiers(F.collect_set(F.col("height").cast("double"))).alias("sizes"))
    tier = F.array_position(F.transform("sizes", lambda s: F.abs(s - F.col("height")) < 0.6), True) - 1
    rows = found.join(sizes, "doc_id").withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("tier", F.when(tier >= 0, tier).otherwise(F.size("sizes") - 1).cast("int"))
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    first_top = F.min(F.when(F.col("tier") <= 1, F.col("n"))).over(Window.partitionBy("doc_id"))
    rows = rows.withColumn("leads", (F.col("tier") == 0) | ((F.col("tier") == 1) & (F.col("n") == first_top)))
    rows = rows.withColumn("first", F.last(F.when(F.col("leads"), F.col("n")), True).over(before))
    rows = rows.withColumn("island", F.coalesce(F.max(F.when(F.col("leads"), F.col("n"))).over(Window.partitionBy("doc_id").orderBy("n")), F.lit(0)))
    inside = Window.partitionBy("doc_id", "island").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("second", F.last(F.when((F.col("tier") == 1) & ~F.col("leads"), F.col("n")), True).over(inside))
    parent = F.when(F.col("leads"), F.lit(None)).when(F.col("tier") == 1, F.col("first")).otherwise(F.coalesce("second", "first"))
    rows = rows.withColumn("parent_n", parent.cast("int"))
    depth = F.when(F.col("parent_n").isNull(), 0).when(F.col("parent_n") == F.col("second"), 2).otherwise(1)
    return rows.select("doc_id", "n", depth.alias("depth"), "parent_n", "title", "page")


def wire_siblings(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, prev, next, first_child, last_child, n_children) of (keys, id, parent, ord) rows."""
    window = Window.partitionBy(*keys, "parent").orderBy("ord", "id")
    side = nodes.select(*keys, "id", F.lag("id").over(window).alias("prev"), F.lead("id").over(window).alias("next"))
    at = F.struct("ord", "id")
    kids = nodes.filter("parent is not null").groupBy(*keys, F.col("parent").alias("id")).agg(F.min_by("id", at).alias("first_child"), F.max_by("id", at).alias("last_child"), F.count("*").alias("n_children"))
    return side.join(kids, [*keys, "id"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
