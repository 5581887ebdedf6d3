"""Redaction: the glyphs that a region meets, the annotations of touched pages, and the document's descriptive entries go.

Boxes meet by grid cells. A box belongs to the level whose cells are as large as it, in powers of two, so it touches two
cells a side at most; it is also placed in the coarser levels that the other side's boxes of its page have. A pair is found
at the coarser of its two levels, in the cell of the lower left corner of what they share: once. So no page, however full,
is paired all with all, and a page's cells are spread over the tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.storage import checkpointed

#: Annotations that carry text: none of a touched page stays. Fixed values.
TEXT_BEARING = ("Text", "FreeText", "Highlight", "Underline", "Squiggly", "StrikeOut", "Caret", "Popup", "FileAttachment", "Stamp")
#: Entries of the document information that go. Fixed values.
DESCRIPTIVE = ("Title", "Author", "Subject", "Keywords")
#: The finest and the coarsest level: boxes smaller or larger than their cells belong to these.
FINEST, COARSEST = -20, 60
SIDES = ("x0", "y0", "x1", "y1")


class Redacted(NamedTuple):
    glyphs: DataFrame
    annotations: DataFrame
    info: DataFrame


def own_level() -> Column:
    """The level of a box: its longer side fits a cell. Null for a box that lacks a side or has an endless one."""
    side = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    whole = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    level = F.when(side > 0, F.ceil(F.log2(side))).otherwise(F.lit(FINEST))
    return F.when(whole & (side < 2.0**COARSEST), F.greatest(level, F.lit(FINEST)).cast("int"))


def cell(x: str | Column, level: str = "level") -> Column:
    return F.floor((F.col(x) if isinstance(x, str) else x) / F.pow(F.lit(2.0), F.col(level)))


def in_cells(boxes: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Boxes with their ``own`` level, a row for each cell (level, cx, cy) that they touch at it and at coarser ones of ``others``."""
    ranked = boxes.withColumn("own", own_level()).filter("own is not null")
    levels = others.select(*keys, own_level().alias("of")).groupBy(*keys).agg(F.collect_set("of").alias("levels"))  # 81 at most
    coarser = F.filter("levels", lambda x: x >= F.col("own"))
    placed = ranked.join(levels, keys).withColumn("level", F.explode(F.array_union(F.array("own"), coarser)))
    spread = lambda low, high: F.explode(F.array_distinct(F.array(cell(low), F.least(cell(low) + 1, cell(high)), F.greatest(cell(low), cell(high)))))
    return placed.drop("levels").withColumn("cx", spread("x0", "x1")).withColumn("cy", spread("y0", "y1"))


def meetings(boxes: DataFrame, others: DataFrame, keys: list[str], left: list[str], right: list[str] | None = None) -> DataFrame:
    """(keys, left, right): each pair of boxes of equal keys that overlap in more than an edge, once; ``right`` of the others.

    Sides are columns x0, y0, x1, y1. Boxes that lack a side or are endless meet nothing; an empty table meets nothing.
    """
    right = right or []
    a = in_cells(boxes.select(*keys, *left, *SIDES), others, keys)
    b = in_cells(others.select(*keys, *right, *SIDES), boxes, keys)
    b = b.withColumnsRenamed({c: f"r_{c}" for c in (*right, *SIDES, "own")})
    met = a.join(b, [*keys, "level", "cx", "cy"]).filter("level = greatest(own, r_own) and x0 < r_x1 and x1 > r_x0 and y0 < r_y1 and y1 > r_y0")
    first = (cell(F.greatest("x0", "r_x0")) == F.col("cx")) & (cell(F.greatest("y0", "r_y0")) == F.col("cy"))
    return met.filter(first).select(*keys, *left, *[F.col(f"r_{c}").alias(c) for c in right])


def without_met(chars: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """``chars`` whose box overlaps no region of equal keys; equal rows are told apart, so each stays or goes by itself."""
    pages = regions.select(*keys).distinct()
    row = "_row"
    touched = checkpointed(chars.join(pages, keys, "left_semi").withColumn(row, F.monotonically_increasing_id()))
    gone = meetings(touched, regions, keys, [row]).select(row).distinct()
    return chars.join(pages, keys, "left_anti").unionByName(touched.join(gone, row, "left_anti").drop(row))


def on_pages(regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Regions in parts of their page's width and height as boxes in the page's own units.

    Page 0 is page 1; regions of pages that are not there are left out. Sides may come in either order.
    """
    placed = regions.withColumn("page", F.greatest("page", F.lit(1)))
    of = pages.select("doc_id", "page", *[F.col(c).alias(f"p_{c}") for c in SIDES])
    wide, high = F.col("p_x1") - F.col("p_x0"), F.col("p_y1") - F.col("p_y0")
    x0, x1 = (F.col("p_x0") + F.col(c) * wide for c in ("x0", "x1"))
    y0, y1 = (F.col("p_y0") + F.col(c) * high for c in ("y0", "y1"))
    boxes = (F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
    return placed.join(of, ["doc_id", "page"]).select("doc_id", "page", *[b.alias(c) for b, c in zip(boxes, SIDES, strict=True)])


def redact(glyphs: DataFrame, annotations: DataFrame, info: DataFrame, regions: DataFrame, pages: DataFrame) -> Redacted:
    """What redacting leaves of glyphs (doc_id, page, x0..y1), annotations (doc_id, page, subtype) and info (doc_id, key).

    regions: (doc_id, page, x0..y1) in parts of the page, pages: (doc_id, page, x0..y1). Glyphs that a region meets go; of
    every page that has a region, annotations that may carry text go, wherever they are; of every document with a region,
    even one on no page, the descriptive entries go. Documents without regions stay as they are.
    """
    boxes = checkpointed(on_pages(regions, pages))
    touched = boxes.select("doc_id", "page").distinct()
    bearing = F.coalesce(F.col("subtype").isin(*TEXT_BEARING), F.lit(False))
    kept = annotations.filter(~bearing).unionByName(annotations.filter(bearing).join(touched, ["doc_id", "page"], "left_anti"))
    telling = F.coalesce(F.col("key").isin(*DESCRIPTIVE), F.lit(False))
    named = info.filter(~telling).unionByName(info.filter(telling).join(regions.select("doc_id").distinct(), "doc_id", "left_anti"))
    return Redacted(without_met(glyphs, boxes, ["doc_id", "page"]), kept, named)
