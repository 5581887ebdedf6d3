"""Annotations, links, comments: filters, the two-sided comment merge, exports and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Annotation kinds that are listed. Fixed values.
SUBTYPES = ("Highlight", "Underline", "StrikeOut", "Square", "Circle", "Line", "FreeText", "Note", "Text", "Ink", "Stamp")
DEFAULT_COLOR = "#f59e0b"


def known_annotations(annots: DataFrame) -> DataFrame:
    return annots.filter(F.col("subtype").isin(*SUBTYPES))


def csv_field(text: Column) -> Column:
    """A field quoted only if it holds a comma, a quote or a line end; quotes inside are doubled."""
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def annotation_csv(annots: DataFrame) -> DataFrame:
    """(doc_id, page, ord, line): a CSV line of page, type, colour, contents and the box to four decimals."""
    text = lambda c: csv_field(F.coalesce(F.col(c), F.lit("")))
    numbers = [F.format_string("%.4f", c) for c in ("x0", "y0", "x1", "y1")]
    return annots.select("doc_id", "page", "ord", F.concat_ws(",", F.col("page").cast("string"), text("subtype"), text("color"), text("contents"), *numbers).alias("line"))


def load_comments(annots: DataFrame, sidecar: DataFrame) -> DataFrame:
    """(doc_id, id, text, color, resolved, created_at, quote, synced): notes of the page and stored comments as one list.

    The note's text and colour win; resolved, quote and created_at are the stored comment's. Of stored comments without
    a note only those never synced stay: the others were deleted elsewhere.
    """
    a = annots.select("doc_id", "id", F.col("text").alias("a_text"), F.col("color").alias("a_color"), F.coalesce("created", "modified").alias("a_created"), F.lit(True).alias("noted"))
    s = sidecar.select("doc_id", "id", F.col("text").alias("s_text"), F.col("color").alias("s_color"), F.col("resolved").alias("s_resolved"), F.col("created_at").alias("s_created"), "quote", F.col("synced").alias("s_synced"))
    both = a.join(s, ["doc_id", "id"], "full_outer").filter("noted or not s_synced")
    text = F.when(F.col("noted"), F.coalesce("a_text", F.lit(""))).otherwise(F.col("s_text"))
    return both.select(
        "doc_id",
        "id",
        text.alias("text"),
        F.coalesce("a_color", "s_color", F.lit(DEFAULT_COLOR)).alias("color"),
        F.coalesce("s_resolved", F.lit(False)).alias("resolved"),
        F.coalesce("s_created", "a_created", F.lit(0.0)).alias("created_at"),
        "quote",
        F.coalesce("noted", F.lit(False)).alias("synced"),
    )


def comment_actions(notes: DataFrame, comments: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, id, action): what saving does to the page's notes: update, keep, insert, skip (no such page) or delete.

    A note changes if its text differs or its colour does in more than case.
    """
    n = notes.select("doc_id", "id", F.coalesce("text", F.lit("")).alias("n_text"), F.lower(F.coalesce("color", F.lit(""))).alias("n_color"), F.lit(True).alias("noted"))
    c = comments.select("doc_id", "id", "page", F.coalesce("text", F.lit("")).alias("c_text"), F.lower(F.coalesce("color", F.lit(""))).alias("c_color"), F.lit(True).alias("wanted"))
    c = c.join(pages.select("doc_id", "page", F.lit(True).alias("there")), ["doc_id", "page"], "left")
    both = n.join(c, ["doc_id", "id"], "full_outer")
    changed = (F.col("n_text") != F.col("c_text")) | (F.col("n_color") != F.col("c_color"))
    action = F.when(F.col("wanted").isNull(), "delete").when(F.col("noted") & changed, "update").when(F.col("noted"), "keep").when(F.col("there"), "insert").otherwise("skip")
    return both.select("doc_id", "id", action.alias("action"))


def comment_changes(notes: DataFrame, comments: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, id, text, color, action): the notes that saving puts or deletes; a put note has the comment's text and colour."""
    told = comment_actions(notes, comments, pages).filter(F.col("action").isin("update", "insert", "delete"))
    new = comments.select("doc_id", "id", F.coalesce("text", F.lit("")).alias("text"), "color")
    return told.join(new, ["doc_id", "id"], "left").select("doc_id", "id", "text", "color", F.when(F.col("action") == "delete", "delete").otherwise("put").alias("action"))


def popups(annots: DataFrame) -> DataFrame:
    """(doc_id, id, popup_id): each note with its popup, if it has one."""
    notes = annots.filter("subtype = 'Text'").select("doc_id", "id")
    boxes = annots.filter("subtype = 'Popup'").select("doc_id", F.col("parent").alias("id"), F.col("id").alias("popup_id"))
    return notes.join(boxes, ["doc_id", "id"], "left")


def merge_in_flight(loaded: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Loaded rows, and held rows whose key was not loaded."""
    return loaded.unionByName(held.join(loaded.select(*keys).distinct(), keys, "left_anti"))


def links_of(pages: DataFrame) -> DataFrame:
    """(page_id, ord, uri) of the href attributes of pages' markup, in order, empty ones left out."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "uri"))
    return found.filter("uri <> ''")


def opens_outside(uri: Column) -> Column:
    return uri.rlike("(?i)^(https?|mailto):")


def page_links(links: DataFrame) -> DataFrame:
    """Links with a target; pages that are counted from 0 become counted from 1."""
    return links.filter("uri is not null or dest_page is not null").withColumn("dest_page", F.col("dest_page") + 1)


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links with new ones that have a target; an address wins over a page."""
    valid = new.filter("uri is not null or dest_page is not null")
    return links.unionByName(valid.withColumn("dest_page", F.when(F.col("uri").isNull(), F.col("dest_page"))))


def remove_link(links: DataFrame, gone: DataFrame) -> DataFrame:
    """Links without the (doc_id, page, index) ones of ``gone``; the index counts a page's links from 0."""
    numbered = links.withColumn("index", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("ord")) - 1)
    return numbered.join(gone, ["doc_id", "page", "index"], "left_anti").drop("index")


def anonymize_report(keys: DataFrame, info: bool = True, xmp: bool = True, scripts: bool = True, files: bool = True, actions: bool = True, authors: bool = True) -> DataFrame:
    """(doc_id, category, removed) of (doc_id, scope, key) rows: what each switch takes away.

    Scripts or files both drop the whole name tree; authors also drop a note's name and date but count its author only.
    """
    #: Keys of each kind. Fixed values.
    info_keys = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
    scope, key = F.col("scope"), F.col("key")
    kind = F.lit(None).cast("string")
    for on, test, name in (
        (info, (scope == "info") & key.isin(*info_keys), "info"),
        (xmp, (scope == "catalog") & (key == "Metadata"), "xmp"),
        (scripts or files, (scope == "catalog") & (key == "Names"), "names"),
        (actions, (scope == "catalog") & (key == "OpenAction"), "open_action"),
        (actions, (scope == "catalog") & (key == "AA"), "additional_actions"),
        (authors, (scope == "annotation") & (key == "T"), "authors"),
    ):
        if on:
            kind = F.when(test, name).otherwise(kind)
    return keys.withColumn("category", kind).filter("category is not null").groupBy("doc_id", "category").agg(F.count("*").alias("removed"))


def in_page_order(comments: DataFrame) -> DataFrame:
    """(doc_id, place, id): a document's comments down its pages: by page, then height on the page, then id."""
    down = Window.partitionBy("doc_id").orderBy("page_index", "y", "id")
    return comments.select("doc_id", F.row_number().over(down).alias("place"), "id")
