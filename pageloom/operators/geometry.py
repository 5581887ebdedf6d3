"""Rectangles, colours, resolutions, watermark lattices, strokes and templates, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def page_rect(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """A top-left rectangle in [0, 1] as points from the bottom left, corners put in order."""
    left, right, top, bottom = x0 * width, x1 * width, (1 - y0) * height, (1 - y1) * height
    return F.struct(F.least(left, right).alias("llx"), F.least(bottom, top).alias("lly"), F.greatest(left, right).alias("urx"), F.greatest(bottom, top).alias("ury"))


def unit_rect(llx: Column, lly: Column, urx: Column, ury: Column, width: Column, height: Column) -> Column:
    """Points from the bottom left as a top-left rectangle, cut to [0, 1]."""
    return F.struct(clamp(llx / width).alias("x0"), clamp((height - ury) / height).alias("y0"), clamp(urx / width).alias("x1"), clamp((height - lly) / height).alias("y1"))


def color_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of parts in [0, 1], rounded half up and cut to a byte."""
    part = lambda x: F.lpad(F.lower(F.hex(F.least(F.greatest(F.round(x * 255), F.lit(0)), F.lit(255)).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def hex_color(color: Column, missing: int = 0) -> Column:
    """(r, g, b) in [0, 1] of #rrggbb; each part that is no hex number is ``missing`` / 255."""
    bare = F.regexp_replace(color, "^#", "")

    def part(i: int) -> Column:
        two = F.substring(bare, i, 2)
        return F.when(two.rlike("^[0-9a-fA-F]{2}$"), F.conv(two, 16, 10).cast("double")).otherwise(F.lit(float(missing))) / 255

    return F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"))


def target_size(width: Column, height: Column, drawn_w: Column, drawn_h: Column, dpi: int | None = 150, threshold: float = 1.5, cap: int | None = 3000) -> Column:
    """(w, h) in pixels an image needs where it is drawn (points): axes beyond threshold x dpi shrink to dpi, then the longest edge to the cap; never larger, at least 1."""
    w, h = width.cast("double"), height.cast("double")
    if dpi:

        def shrunk(pixels: Column, points: Column) -> Column:
            shown = F.try_divide(pixels, points / 72)
            return F.when((points >= 1) & (shown > dpi * threshold), F.greatest(F.round(pixels * F.try_divide(F.lit(float(dpi)), shown)), F.lit(1.0))).otherwise(pixels)

        w, h = shrunk(w, drawn_w), shrunk(h, drawn_h)
    if cap:
        longest = F.greatest(w, h)
        fit = lambda x: F.when(longest > cap, F.greatest(F.round(x * (cap / longest)), F.lit(1.0))).otherwise(x)
        w, h = fit(w), fit(h)
    return F.struct(F.greatest(F.least(w, width), F.lit(1)).cast("int").alias("w"), F.greatest(F.least(h, height), F.lit(1)).cast("int").alias("h"))


def footprints(draws: DataFrame, keys: list[str]) -> DataFrame:
    """The largest drawn width and height of each image, taken apart."""
    return draws.groupBy(*keys).agg(F.max("w").alias("w"), F.max("h").alias("h"))


def tiles(text: Column, width: Column, height: Column, size: float) -> Column:
    """Start points of a tiled watermark: an array of (row, col, x, y); odd rows are shifted by half a step."""
    wide = F.length(text) * size * 0.55
    step_x, step_y = F.greatest(wide * 1.5 + size, F.lit(120.0)), F.greatest(F.lit(size * 3.5), F.lit(80.0))
    rows = F.sequence(F.lit(0), F.greatest(F.ceil((height + step_y * 0.5) / step_y) - 1, F.lit(0)).cast("int"))

    def row(i: Column) -> Column:
        start = F.when(i % 2 == 0, F.lit(0.0)).otherwise(step_x * 0.5) - step_x * 0.25
        cols = F.sequence(F.lit(0), F.greatest(F.ceil((width + step_x - start) / step_x) - 1, F.lit(0)).cast("int"))
        return F.transform(cols, lambda j: F.struct(i.alias("row"), j.alias("col"), (start + j * step_x).alias("x"), (step_y * 0.5 + i * step_y).alias("y")))

    return F.flatten(F.transform(rows, row))


def watermark_point(text: Column, width: Column, height: Column, size: float, degrees: float | None) -> Column:
    """(x, y) where one watermark starts so that it is centred, level if no angle is given."""
    wide = F.length(text) * size * 0.55
    if degrees is None:
        return F.struct((width / 2 - wide / 2).alias("x"), (height / 2 - size / 3).alias("y"))
    c, s = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    return F.struct((width / 2 - wide / 2 * c - size / 3 * s).alias("x"), (height / 2 + wide / 2 * s - size / 3 * c).alias("y"))


def ocr_layout(words: DataFrame, least: float = 30) -> DataFrame:
    """Recognised words with confidence above ``least`` and some text, as baseline points: x, y from the bottom left, size of 4 at least."""
    text = F.trim("text")
    kept = words.filter((F.col("confidence") > least) & (text != ""))
    y = F.col("height") - (F.col("y") + F.col("h")) * F.col("height")
    return kept.select("doc_id", "page", "ord", text.alias("text"), (F.col("x") * F.col("width")).alias("x"), y.alias("y"), F.greatest(F.col("h") * F.col("height"), F.lit(4.0)).alias("size"))


def curve_segments(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seg, two control points, end point) of (keys, ord, x, y) points: each segment leans on its neighbours, the ends on themselves."""
    window = Window.partitionBy(*keys).orderBy("ord")
    at = lambda c, n: F.coalesce(F.lag(c, -n).over(window), F.first_value(c).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if n < 0 else F.last_value(c).over(window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = points.select(*keys, "ord", *[at(c, n).alias(f"{c}{k}") for c in "xy" for k, n in (("p", -1), ("n", 1), ("nn", 2))], "x", "y", F.lead("ord").over(window).alias("more"), F.row_number().over(window).alias("seg"))
    rows = rows.filter("more is not null")
    out = {f"c1{c}": F.col(c) + (F.col(f"{c}n") - F.col(f"{c}p")) / 6 for c in "xy"} | {f"c2{c}": F.col(f"{c}n") - (F.col(f"{c}nn") - F.col(c)) / 6 for c in "xy"} | {f"{c}1": F.col(f"{c}n") for c in "xy"}
    return rows.select(*keys, "seg", *[v.alias(k) for k, v in out.items()])


def erase(points: DataFrame, keys: list[str], x: float, y: float, radius: float, width: float, height: float) -> DataFrame:
    """(keys, fragment, ord, x, y): what an eraser at (x, y) leaves of strokes: runs of two points or more, numbered anew.

    A touched curve goes as a whole. Untouched strokes stay as they are, even of one point.
    """
    hit = F.pow((F.col("x") - x) * width, 2) + F.pow((F.col("y") - y) * height, 2) <= radius * radius
    window = Window.partitionBy(*keys)
    rows = points.withColumn("hit", hit).withColumn("touched", F.max(hit).over(window))
    rows = rows.filter(~F.col("hit") & ~(F.col("touched") & (F.col("tool") == "bezier")))
    run = F.col("ord") - F.row_number().over(window.orderBy("ord"))
    rows = rows.withColumn("run", run)
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "run"))).filter("not touched or n >= 2")
    return rows.select(*keys, F.dense_rank().over(window.orderBy("run")).alias("fragment"), "ord", "x", "y")


def template_marks(kind: Column, width: Column, height: Column, step: float = 20.0) -> Column:
    """How many lines or dots a blank page's template has: ruled, grid, dotted; none for others."""
    below = lambda span: F.greatest(F.ceil(span / step), F.lit(0))  # marks at step, 2 step, … while under the span
    ruled = below(height - 30 - 20)
    grid = below(height - step) + below(width - step)
    dotted = below(height - step - step / 2) * below(width - step / 2 - step)
    return F.when(kind == "ruled", ruled).when(kind == "grid", grid).when(kind == "dotted", dotted).otherwise(0).cast("long")


def template_lines(kind: Column, width: Column, height: Column, step: float = 20.0) -> Column:
    """The marks of a blank page's template, as an array of (x0, y0, x1, y1): ruled lines from the top down, a grid's lines
    across and then up, or dots as squares of 1.6 points row by row; none for other kinds. Margins are fixed values."""

    def places(first: Column, n: Column, sign: int) -> Column:
        count = F.greatest(n, F.lit(0)).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: first + sign * step * (i - 1))).otherwise(F.array().cast("array<double>"))

    def mark(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.struct(*[c.cast("double").alias(name) for c, name in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])

    none = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")
    down = lambda first, least: places(first, F.ceil((first - least) / step), -1)  # noqa: E731  places above ``least``
    ruled = F.transform(down(height - 30.0, 20.0), lambda y: mark(F.lit(25.0), y, width - 25.0, y))
    across = F.transform(down(height - step, 0.0), lambda y: mark(F.lit(0.0), y, width, y))
    up = F.transform(places(F.lit(step), F.ceil((width - step) / step), 1), lambda x: mark(x, F.lit(0.0), x, height))
    columns = places(F.lit(step), F.ceil((width - step / 2 - step) / step), 1)
    dots = F.flatten(F.transform(down(height - step, step / 2), lambda y: F.transform(columns, lambda x: mark(x - 0.8, y - 0.8, x + 0.8, y + 0.8))))
    return F.when(kind == "ruled", ruled).when(kind == "grid", F.concat(across, up)).when(kind == "dotted", dots).otherwise(none)


#: Compression levels: name, JPEG quality, dots an inch, threshold, longest edge, metadata stripped, zlib level. Fixed values.
PRESETS = [
    ("lossless", 0, None, 1.5, None, False, 6),
    ("book", 78, 150, 1.5, 3000, True, 6),
    ("screen", 65, 72, 1.5, 2000, True, 6),
]


def presets(spark: SparkSession) -> DataFrame:
    """(level, name, quality, dpi, threshold, longest, strip_metadata, zlib) of the compression levels."""
    schema = "level int, name string, quality int, dpi int, threshold double, longest int, strip_metadata boolean, zlib int"
    return spark.createDataFrame([(level, *row) for level, row in enumerate(PRESETS)], schema)


def highlight_boxes(chars: DataFrame, keys: list[str]) -> DataFrame:
    """One box a match and text row: (keys, match) characters by the middle of their height in steps of 1/500."""
    band = F.round((F.col("y0") + F.col("y1")) / 2 * 500).cast("long")
    return chars.withColumn("band", band).groupBy(*keys, "match", "band").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
