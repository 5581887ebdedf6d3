"""Page sequences: merge, split, remove, reorder, interleave, page lists. Every sequence carries its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.sums import sum_before


def merge_sequences(pages: DataFrame, order: DataFrame) -> DataFrame:
    """Documents joined into one, by (merged_id, ord, doc_id) rows of ``order``: (merged_id, position, doc_id, page).

    A document's pages start after those of all before it. Prefix sums run over documents, not pages.
    """
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    starts = sum_before(order.join(counts, "doc_id"), ["merged_id"], ["ord", "doc_id"], F.col("n"), "start")
    return starts.join(pages.select("doc_id", "page"), "doc_id").select("merged_id", (F.col("start") + F.col("page")).alias("position"), "doc_id", "page")


def split_ranges(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, part, position, page) of each range (doc_id, part, start, stop), cut to the document; ranges may overlap.

    A range that starts after it stops, once cut, gives no rows: ``range_errors`` lists those.
    """
    fit = fitted(pages, ranges)
    return fit.filter("start <= stop").select("doc_id", "part", "start", F.explode(F.sequence("start", "stop")).alias("page")).select("doc_id", "part", (F.col("page") - F.col("start") + 1).cast("int").alias("position"), F.col("page").cast("int").alias("page"))


def fitted(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    totals = pages.groupBy("doc_id").agg(F.max("page").alias("total"))
    return ranges.join(totals, "doc_id").select("doc_id", "part", F.greatest("start", F.lit(1)).cast("long").alias("start"), F.least("stop", "total").cast("long").alias("stop"))


def range_errors(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    return fitted(pages, ranges).filter("start > stop").select("doc_id", "part", "start", "stop")


def split_per_page(pages: DataFrame) -> DataFrame:
    """(doc_id, page, label): one part a page, named by a page number of four digits or more."""
    return pages.select("doc_id", "page", F.concat(F.lit("_page"), F.format_string("%04d", "page")).alias("label"))


def split_every(pages: DataFrame, n: int) -> DataFrame:
    """(doc_id, part, start, stop): ranges of n pages, the last one shorter if need be."""
    totals = pages.groupBy("doc_id").agg(F.max("page").cast("int").alias("total"))
    starts = totals.select("doc_id", "total", F.posexplode(F.sequence(F.lit(1), F.col("total"), F.lit(n))).alias("at", "start"))
    return starts.select("doc_id", (F.col("at") + 1).alias("part"), "start", F.least(F.col("start") + n - 1, "total").alias("stop"))


def safe_name(title: Column, part: Column) -> Column:
    """A title as a file name: other characters than letters, digits, blanks and hyphens become ``_``; empty ones get their number."""
    name = F.trim(F.regexp_replace(title, r"[^\p{L}\p{N} \-]", "_"))
    return F.when((name == "") | name.isNull(), F.concat(F.lit("part"), part.cast("string"))).otherwise(name)


def split_at_bookmarks(totals: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """(doc_id, part, label, start, stop) from (doc_id, ord, title, page) and (doc_id, total) rows.

    The first bookmark of a page counts; a part ends before the next one starts, the last with the document; pages
    before the first bookmark are in no part. Parts are told apart by number, so equal titles stay apart.
    """
    first = bookmarks.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord"))).filter("n = 1")
    window = Window.partitionBy("doc_id").orderBy("page")
    parts = first.withColumn("part", F.row_number().over(window)).withColumn("next", F.lead("page").over(window))
    out = parts.join(totals, "doc_id")
    return out.select("doc_id", "part", safe_name(F.col("title"), F.col("part")).alias("label"), F.col("page").alias("start"), F.coalesce(F.col("next") - 1, F.col("total")).cast("int").alias("stop"))


def remove_pages(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, page, old_page) without the (doc_id, page) rows of ``gone``, numbered anew."""
    left = pages.select("doc_id", "page").join(gone.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return left.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")).alias("page"), F.col("page").alias("old_page"))


def removal_errors(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, message) where a page is out of range or no page would be left."""
    totals = pages.groupBy("doc_id").agg(F.max("page").alias("total"))
    asked = gone.groupBy("doc_id").agg(F.countDistinct("page").alias("n"), F.min("page").alias("low"), F.max("page").alias("high"))
    both = asked.join(totals, "doc_id")
    message = F.when((F.col("low") < 1) | (F.col("high") > F.col("total")), "page out of range").when(F.col("n") >= F.col("total"), "no page would be left")
    return both.select("doc_id", message.alias("message")).filter("message is not null")


def reorder_pages(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """(doc_id, page, old_page) by (doc_id, new_order) rows, an array of old pages; only true permutations apply.

    A document whose order has the wrong length, repeats or unknown pages keeps its own order.
    """
    totals = pages.groupBy("doc_id").agg(F.max("page").cast("int").alias("total"))
    fits = F.array_sort(F.col("new_order").cast("array<int>")) == F.sequence(F.lit(1), F.col("total"))
    asked = totals.join(orders, "doc_id", "left")
    order = F.when(F.coalesce(fits, F.lit(False)), F.col("new_order").cast("array<int>")).otherwise(F.sequence(F.lit(1), F.col("total")))
    return asked.select("doc_id", F.posexplode(order).alias("at", "old_page")).select("doc_id", (F.col("at") + 1).alias("page"), "old_page")


def interleave(pages: DataFrame, inserted: DataFrame) -> DataFrame:
    """(doc_id, page, source, old) with (doc_id, after, ord) pages put in after page ``after`` (0: before all, cut to the document)."""
    totals = pages.groupBy("doc_id").agg(F.max("page").alias("total"))
    own = pages.select("doc_id", F.col("page").alias("anchor"), F.lit(0).alias("new"), F.lit(0).alias("ord"), F.col("page").cast("int").alias("old"))
    put = inserted.join(totals, "doc_id").select("doc_id", F.least(F.greatest("after", F.lit(0)), "total").alias("anchor"), F.lit(1).alias("new"), "ord", F.col("ord").cast("int").alias("old"))
    window = Window.partitionBy("doc_id").orderBy("anchor", "new", "ord")
    both = own.unionByName(put)
    return both.select("doc_id", F.row_number().over(window).alias("page"), F.when(F.col("new") == 1, "inserted").otherwise("own").alias("source"), "old")


def move_page(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """(doc_id, page, old_page) after (doc_id, source, target) moves: out of its place, in before ``target``, else at the end."""
    both = pages.select("doc_id", "page").join(moves, "doc_id", "left")
    key = F.when(F.col("page") == F.col("source"), F.coalesce(F.col("target") - 0.5, F.lit(float("inf")))).otherwise(F.col("page").cast("double"))
    return both.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(key, "page")).alias("page"), F.col("page").cast("int").alias("old_page"))


def whole(text: Column) -> Column:
    return F.when(F.trim(text).rlike("^[0-9]{1,9}$"), F.trim(text)).cast("long")


def parse_pages(column: Column, most: Column) -> Column:
    """The sorted, distinct pages of a list such as ``1, 3-5, 7``; parts that are no page or range up to ``most`` are dropped."""

    def pages(part: Column) -> Column:
        ends = F.split(part, "-")
        low, high = whole(F.get(ends, F.lit(0))), whole(F.get(ends, F.lit(1)))
        span = F.when((low >= 1) & (high >= low) & (high <= most) & (F.size(ends) == 2), F.sequence(low, high))
        single = F.when((low >= 1) & (low <= most), F.array(low))
        return F.coalesce(F.when(F.size(ends) > 1, span).otherwise(single), F.array().cast("array<bigint>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(column, ","), pages))))


def parse_ranges(column: Column, most: Column) -> Column:
    """Like ``parse_pages``, but ranges stay whole, in the order given: an array of (start, stop)."""

    def span(part: Column) -> Column:
        ends = F.split(part, "-")
        low, high = whole(F.get(ends, F.lit(0))), whole(F.get(ends, F.lit(1)))
        high = F.when(F.size(ends) == 1, low).otherwise(high)
        return F.when((low >= 1) & (high >= low) & (high <= most) & (F.size(ends) <= 2), F.struct(low.alias("start"), high.alias("stop")))

    return F.filter(F.transform(F.split(column, ","), span), lambda x: x.isNotNull())


def format_pages(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, pages): the page rows of each key as ``1, 3-5, 7``, by gaps and islands."""
    distinct = rows.select(*keys, F.col("page").cast("long").alias("page")).distinct()
    island = F.col("page") - F.row_number().over(Window.partitionBy(*keys).orderBy("page"))
    spans = distinct.withColumn("island", island).groupBy(*keys, "island").agg(F.min("page").alias("low"), F.max("page").alias("high"))
    text = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high"))
    spans = spans.select(*keys, F.struct("low", text.alias("text")).alias("span"))
    return spans.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("span")), lambda s: s["text"]), ", ").alias("pages"))
