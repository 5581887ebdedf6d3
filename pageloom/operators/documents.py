"""Documents as wholes: their metadata, pages and pictures, caches of several levels, and what writing one back decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.geometry import page_rect, target_size
from pageloom.operators.trees import nearest_ancestor

#: Keys of a document's information. Fixed values; the first five can be written.
INFO_KEYS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer", "CreationDate", "ModDate")
WRITABLE = INFO_KEYS[:5]
LETTER, A4 = (612.0, 792.0), (595.0, 842.0)


def info_columns(entries: DataFrame) -> DataFrame:
    """(doc_id, a column a key) of (doc_id, key, value, ord) rows; the last value of a key counts, other keys are left out."""
    last = lambda k: F.max_by("value", F.when(F.col("key") == k, F.col("ord"))).alias(k.lower())
    return entries.groupBy("doc_id").agg(*[last(k) for k in INFO_KEYS])


def set_info(entries: DataFrame, updates: DataFrame) -> DataFrame:
    """(doc_id, key, value) after updates (doc_id, key, value): null keeps the old value, only writable keys are written."""
    new = updates.filter(F.col("key").isin(*WRITABLE) & F.col("value").isNotNull()).groupBy("doc_id", "key").agg(F.max("value").alias("new"))
    both = entries.select("doc_id", "key", "value").join(new, ["doc_id", "key"], "full_outer")
    return both.select("doc_id", "key", F.coalesce("new", "value").alias("value"))


def rotate(pages: DataFrame, wanted: Column, degrees: int) -> DataFrame:
    """(doc_id, page, rotate): pages of the list turned by 90, 180 or 270 degrees more; an empty list means all."""
    if degrees not in (90, 180, 270):
        raise ValueError("degrees must be 90, 180 or 270")
    meant = (F.size(wanted) == 0) | F.array_contains(wanted, F.col("page"))
    now = F.coalesce("rotate", F.lit(0))
    return pages.select("doc_id", "page", F.when(meant, (now + degrees) % 360).otherwise(now).alias("rotate"))


def page_list_errors(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, page) asked for by (doc_id, page) rows and not there."""
    return wanted.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def page_sizes(nodes: DataFrame, keys: list[str], default: tuple[float, float] = A4) -> DataFrame:
    """(keys, id, width, height) of (keys, id, parent, box) rows: the nearest box with an area, else the default.

    box: [x0, y0, x1, y1], corners in any order, a null counts as 0; a box of fewer numbers or no area is passed over.
    """
    box = F.col("box")
    side = lambda a, b: F.abs(F.coalesce(F.get(box, b), F.lit(0.0)) - F.coalesce(F.get(box, a), F.lit(0.0)))
    fine = (F.size(box) >= 4) & (side(0, 2) > 0) & (side(1, 3) > 0)
    found = nearest_ancestor(nodes.withColumn("box", F.when(fine, box)), keys, "box")
    return found.select(*keys, "id", *[F.when(box.isNull(), F.lit(d)).otherwise(side(i, i + 2)).alias(n) for i, (n, d) in enumerate(zip(("width", "height"), default, strict=True))])


def fit_image(width: Column, height: Column) -> Column:
    """(w, h, x, y) in millimetres of a picture on an A4 page: within 190 x 270, in proportion, centred."""
    aspect = width / height
    wide = aspect > 190.0 / 270.0
    w, h = F.when(wide, F.lit(190.0)).otherwise(aspect * 270.0), F.when(wide, F.lit(190.0) / aspect).otherwise(F.lit(270.0))
    return F.struct(w.alias("w"), h.alias("h"), ((210.0 - w) / 2).alias("x"), ((297.0 - h) / 2).alias("y"))


def image_names(stem: Column, page: Column, kind: str = "png") -> Column:
    return F.concat(stem, F.lit("_"), F.format_string("%04d", page), F.lit(f".{kind}"))


def image_plans(images: DataFrame, drawn: DataFrame, dpi: int = 150, cap: int = 3000, most_pixels: int = 120_000_000) -> DataFrame:
    """(image_id, target_w, target_h) of the pictures worth coding anew, from (image_id, width, height, bits, mask, dct, supported) rows.

    Masks, one-bit, empty and huge pictures are left alone, and so are unknown colour spaces unless the picture is a
    JPEG; a JPEG is taken only if it gets smaller. drawn: (image_id, w, h), the largest footprint in points.
    """
    usable = images.filter(~F.col("mask") & (F.col("bits") != 1) & (F.col("width") > 0) & (F.col("height") > 0))
    usable = usable.filter((F.col("width").cast("long") * F.col("height") <= most_pixels) & (F.col("dct") | F.col("supported")))
    both = usable.join(drawn, "image_id", "left")
    size = target_size(F.col("width"), F.col("height"), F.coalesce("w", F.lit(0.0)), F.coalesce("h", F.lit(0.0)), dpi, cap=cap)
    plans = both.select("image_id", "dct", "width", "height", size.alias("to"))
    same = (F.col("to.w") == F.col("width")) & (F.col("to.h") == F.col("height"))
    return plans.filter(~(F.col("dct") & same)).select("image_id", F.col("to.w").alias("target_w"), F.col("to.h").alias("target_h"))


def live_objects(objects: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Objects that are not excluded, free, null, or containers of the file's own."""
    fine = objects.filter(~F.col("free") & (F.col("kind") != "Null") & ~F.coalesce(F.col("type_name"), F.lit("")).isin("XRef", "ObjStm"))
    return fine.join(excluded, keys, "left_anti")


def smaller(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Rows with ``kept`` (new or old) and ``bytes``: the new size only where it is really smaller, or the old one is missing."""
    better = F.coalesce(F.col(new) < F.col(old), F.col(new).isNotNull())
    return rows.withColumn("kept", F.when(better, "new").otherwise("old")).withColumn("bytes", F.when(better, F.col(new)).otherwise(F.col(old)))


def repair_report(attempts: DataFrame, fallback: bool = True, dpi: int | None = None) -> DataFrame:
    """(doc_id, mode, before, after, dpi): the strict rewrite if it gave bytes, else the pictures of the pages if asked for, else failed."""
    sharp = min(max(dpi if dpi is not None else 200, 72), 600)
    raster = F.col("raster_bytes") if fallback else F.lit(None).cast("long")
    mode = F.when(F.col("rewrite_bytes").isNotNull(), "rewrite").when(raster.isNotNull(), "raster").otherwise("failed")
    return attempts.select("doc_id", mode.alias("mode"), F.col("before"), F.coalesce("rewrite_bytes", raster).alias("after"), F.when(mode == "raster", sharp).alias("dpi"))


def add_annotations(annots: DataFrame, new: DataFrame, pages: DataFrame) -> DataFrame:
    """Annotations (doc_id, page, subtype, llx, lly, urx, ury, opacity) with new ones, given by top-left boxes in [0, 1].

    Highlights are half transparent; those for pages that are not there are left out.
    """
    placed = new.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"])
    rect = page_rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("width"), F.col("height"))
    opacity = F.when(F.col("subtype") == "Highlight", 0.5).otherwise(1.0)
    rows = placed.select("doc_id", "page", "subtype", rect.alias("r"), opacity.alias("opacity"))
    return annots.unionByName(rows.select("doc_id", "page", "subtype", "r.*", "opacity"))


def widget_pages(widgets: DataFrame, pages: DataFrame) -> DataFrame:
    """Each widget with its page, the first one if its own is unknown, and that page's size or Letter."""
    at = widgets.join(pages.select("doc_id", "page_num", F.col("page").alias("found")), ["doc_id", "page_num"], "left")
    at = at.withColumn("page", F.coalesce("found", F.lit(1))).drop("found")
    sizes = pages.select("doc_id", "page", "width", "height")
    both = at.join(sizes, ["doc_id", "page"], "left")
    return both.select("doc_id", "widget", "page", F.coalesce("width", F.lit(LETTER[0])).alias("width"), F.coalesce("height", F.lit(LETTER[1])).alias("height"))


def overlay(base: DataFrame, *over: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys of ``base`` with the value of the last table that has one."""
    out = base
    for n, table in enumerate(over):
        out = out.join(table.select(*keys, F.col(value).alias(f"{value}_{n}")), keys, "left")
    named = [f"{value}_{n}" for n in reversed(range(len(over)))]
    return out.select(*keys, F.coalesce(*named, value).alias(value))


def cache_levels(wanted: DataFrame, levels: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """Each wanted key with the value of the first level that has it, and that level's number, 0 for none."""
    out = wanted
    for n, level in enumerate(levels, 1):
        out = out.join(level.select(*keys, F.col(value).alias(f"{value}_{n}")), keys, "left")
    found = [F.col(f"{value}_{n}") for n in range(1, len(levels) + 1)]
    level = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in enumerate(found, 1)], F.lit(0))
    return out.select(*keys, F.coalesce(*found).alias(value), level.alias("level"))


def seed_cache(cached: DataFrame, reordered: DataFrame) -> DataFrame:
    """Cached pages (doc_id, page, value) under their new places, by (doc_id, page, old_page)."""
    old = cached.withColumnRenamed("page", "old_page")
    return reordered.join(old, ["doc_id", "old_page"]).select("doc_id", "page", "value")


def to_sidecar(comments: DataFrame) -> DataFrame:
    """(doc_id, sidecar): a document's comments, in id order, as one JSON list."""
    fields = [c for c in comments.columns if c != "doc_id"]
    listed = F.array_sort(F.collect_list(F.struct(*sorted(fields, key=lambda c: c != "id"))))
    return comments.groupBy("doc_id").agg(F.to_json(listed).alias("sidecar"))


def from_sidecar(files: DataFrame, schema: str) -> DataFrame:
    """Comments of (doc_id, sidecar) rows; a list that can't be read counts as empty."""
    return files.select("doc_id", F.inline(F.coalesce(F.from_json("sidecar", f"array<struct<{schema}>>"), F.array().cast(f"array<struct<{schema}>>"))))


def roomiest(disks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, disk, total, used): of each key's disks the largest, ties to the first by name; used is never below zero."""
    best = disks.groupBy(*keys).agg(F.min_by(F.struct("disk", "total", "available"), F.struct(-F.col("total"), "disk")).alias("d"))
    return best.select(*keys, "d.disk", "d.total", F.greatest(F.col("d.total") - F.col("d.available"), F.lit(0)).alias("used"))


def canvas_size(css_width: Column, aspect: Column, ratio: Column, most_ratio: float = 2.0, longest: int = 2600) -> Column:
    """(width, height) of a drawing surface: the screen's ratio within [1, most_ratio], no side beyond ``longest``."""
    sharp = F.greatest(F.lit(1.0), F.least(F.coalesce(ratio, F.lit(1.0)), F.lit(most_ratio)))
    w = F.greatest(F.lit(1.0), F.round(css_width * sharp))
    h = F.greatest(F.lit(1.0), F.round(w * aspect))
    k = longest / F.greatest(w, h)
    cut = lambda x: F.when(k < 1, F.greatest(F.lit(1.0), F.round(x * k))).otherwise(x).cast("long")
    return F.struct(cut(w).alias("width"), cut(h).alias("height"))


def from_data_url(text: Column) -> Column:
    """The bytes of base64, with or without the head of a data URL."""
    return F.unbase64(F.regexp_replace(text, r"^data:[^,]*,", ""))


def text_of(content: Column) -> Column:
    """Bytes as text: UTF-16 of either order by its mark, else UTF-8; what is no character becomes the replacement one."""
    mark = F.hex(F.substring(content, 1, 2))
    return F.when(mark == "FEFF", F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE")).when(mark == "FFFE", F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE")).otherwise(F.make_valid_utf8(content.cast("string")))


def bytes_of(text: Column) -> Column:
    """ASCII as it is, any other text as UTF-16 with its mark."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text.cast("binary")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE")))


def bookmark_pages(bookmarks: DataFrame, pages: DataFrame) -> DataFrame:
    """Bookmarks (doc_id, ord, dest) with the number of the page they lead to; those that lead nowhere are left out."""
    return bookmarks.join(pages.select("doc_id", F.col("num").alias("dest"), "page"), ["doc_id", "dest"]).select("doc_id", "ord", "page")


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``page``: their number within the keys, in order."""
    return rows.withColumn("page", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
