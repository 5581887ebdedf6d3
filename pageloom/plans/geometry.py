"""Queries on geometry and scalar functions over embeddings, parts and events, with their SQL. Doubles are rounded to 6 places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions import scalar
from pageloom.operators import geometry, labels
from pageloom.sources.tables import table


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, no negative zero."""
    return df.select(*[(F.round(c, 6) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def unit(i: int) -> F.Column:
    """The i-th number of a vector, from 1, brought into [0, 1]."""
    return (F.get("embedding", F.lit(i - 1)).cast("double") + 1) / 2


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def rect_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = geometry.page_rect(unit(1), unit(2), unit(3), unit(4), F.lit(612.0), F.lit(792.0))
    rows = vectors(spark, sf_dir).select("vec_id", points.alias("p"))
    back = geometry.unit_rect(F.col("p.llx"), F.col("p.lly"), F.col("p.urx"), F.col("p.ury"), F.lit(612.0), F.lit(792.0))
    return rounded(rows.select("vec_id", "p.*", back.alias("u")).select("vec_id", "llx", "lly", "urx", "ury", "u.*"))


def color_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours out of range are cut to a byte; the way back gives parts of 255."""
    n = (F.col("label") + F.col("vec_id") % 7).cast("double")
    code = geometry.color_hex(n / 8, n / 4 - 0.5, n / 16 + 0.125)
    rows = vectors(spark, sf_dir).select("vec_id", code.alias("color"))
    return rounded(rows.select("vec_id", "color", geometry.hex_color(F.col("color")).alias("c")).select("vec_id", "color", "c.*"))


def dpi_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 120).alias("w"), (F.col("p_size") * 90 + F.col("p_partkey") % 500).cast("int").alias("h"), (F.col("p_partkey") % 700).cast("double").alias("pw"), (F.col("p_partkey") % 900 / 2.0).alias("ph"))
    both = {name: geometry.target_size(F.col("w"), F.col("h"), F.col("pw"), F.col("ph"), dpi, cap=cap) for name, dpi, cap in (("book", 150, 3000), ("screen", 72, 2000), ("lossless", None, None))}
    out = rows.select("p_partkey", *[size.alias(name) for name, size in both.items()])
    return out.select("p_partkey", *[F.col(f"{name}.{side}").alias(f"{name}_{side}") for name in both for side in "wh"])


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("h"))
    return geometry.footprints(draws, ["l_partkey"])


def watermark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "region").select("r_name", F.inline(geometry.tiles(F.col("r_name"), F.lit(595.0), F.lit(842.0), 48.0)))
    return rounded(rows.withColumnsRenamed({"row": "tile_row", "col": "tile_col"}))


def watermark_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_name", geometry.watermark_point(F.col("n_name"), F.lit(595.0), F.lit(842.0), 48.0, 45.0).alias("d"), geometry.watermark_point(F.col("n_name"), F.lit(595.0), F.lit(842.0), 48.0, None).alias("c"))
    return rounded(rows.select("n_name", F.col("d.x").alias("dx"), F.col("d.y").alias("dy"), F.col("c.x").alias("cx"), F.col("c.y").alias("cy")))


def text_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    spots = F.array(*[F.lit(f"{v}-{h}") for v in ("top", "bottom") for h in ("left", "center", "right")], F.lit("elsewhere"))
    rows = table(spark, sf_dir, "nation").select("n_name", F.explode(spots).alias("position"))
    return rounded(rows.select("n_name", "position", labels.anchor(F.col("position"), F.col("n_name"), F.lit(612.0), F.lit(792.0), 10.0, 36.0).alias("a")).select("n_name", "position", "a.x", "a.y"))


def strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as a stroke of 32 points; every third one is a curve."""
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(((F.get("embedding", i * 2).cast("double") + 1) / 2).alias("x"), ((F.get("embedding", i * 2 + 1).cast("double") + 1) / 2).alias("y")))
    rows = vectors(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 3 == 0, "bezier").otherwise("pen").alias("tool"), F.posexplode(pairs).alias("ord", "p"))
    return rows.select("vec_id", "tool", "ord", "p.x", "p.y")


def catmull_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.curve_segments(strokes(spark, sf_dir), ["vec_id"]))


def eraser_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(geometry.erase(strokes(spark, sf_dir), ["vec_id"], 0.5, 0.5, 40.0, 768.0, 1000.0))


def strokes_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = strokes(spark, sf_dir).groupBy("vec_id").agg(F.count("*").alias("points"))
    return rows.groupBy((F.col("vec_id") % 10).alias("page")).agg(F.count("*").alias("strokes"), F.sum("points").alias("points"))


def template_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*[F.lit(k) for k in ("ruled", "grid", "dotted", "blank")]), (F.col("p_partkey") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), geometry.template_marks(kind, F.col("p_size") * 20.0, F.col("p_size") * 30.0).alias("marks"))


def highlight_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of strokes as characters of one match, a tenth of the page high."""
    rows = strokes(spark, sf_dir)
    chars = rows.select("vec_id", F.lit(1).alias("match"), "x", F.floor(F.col("y") * 10).alias("r"))
    boxed = chars.select("vec_id", "match", F.col("x").alias("x0"), (F.col("x") + 0.01).alias("x1"), (F.col("r") / 10).alias("y0"), (F.col("r") / 10 + 0.1).alias("y1"))
    return rounded(geometry.highlight_boxes(boxed, ["vec_id"]))


def ocr_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as recognised words, the value as confidence."""
    n = F.col("event_id")
    words = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), (n % 5 + 1).alias("page"), n.alias("ord"), F.when(n % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "event_type")).alias("text"), F.col("value").alias("confidence"), (n % 10 / 10.0).alias("x"), (n % 7 / 10.0).alias("y"), (n % 3 / 400.0).alias("h"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    return rounded(geometry.ocr_layout(words))


def ocr_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_layout(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("words"))


def crop_and_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page boxes of a crop that is not cut to the page, and rotations that keep the sign of the remainder."""
    n = F.col("p_partkey")
    box = geometry.page_rect(F.lit(-0.1), (n % 10) / 10.0, F.lit(1.2), F.lit(0.9), F.col("p_size") * 10.0, F.col("p_size") * 14.0)
    turn = (F.coalesce(F.when(n % 3 != 0, (n % 4 - 2) * 90), F.lit(0)) + 270) % 360
    return rounded(table(spark, sf_dir, "part").select("p_partkey", box.alias("b"), turn.cast("long").alias("rotate")).select("p_partkey", "b.*", "rotate"))


def aspect_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height by width of parts as pages; no width, no ratio."""
    return rounded(table(spark, sf_dir, "part").select("p_partkey", F.try_divide(F.col("p_retailprice"), (F.col("p_size") % 7).cast("double")).alias("ratio")))


def pdf_date_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp")) - F.when(F.col("event_id") % 3 == 0, F.lit(2_000_000_000_000)).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", scalar.pdf_date(millis).alias("written"))


def pdf_date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates with parts missing or out of range, February's 31st among them."""
    n = F.col("event_id")
    year = (1990 + n % 40).cast("string")
    text = F.get(F.array(F.concat(F.lit("D:"), year, F.lit("0231101112Z")), F.concat(year, F.lit("1399")), F.concat(F.lit("D:"), year), F.lit("D:19"), F.concat(F.lit("D:"), year, F.lit("0010256199+01'00'"))), (n % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("text"), scalar.parse_pdf_date(text).alias("millis"))


def human_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalar.human_bytes(F.octet_length("text").cast("long") * (F.col("doc_id") % 1000 + 1)).alias("size"))


def relative_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    now = rows.agg(F.max(F.unix_millis(F.col("ts").cast("timestamp")))).scalar()
    return rows.select("event_id", scalar.relative_time(F.unix_millis(F.col("ts").cast("timestamp")), now).alias("ago"))


def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines as file names."""
    from pageloom.operators.sequence import safe_name

    return table(spark, sf_dir, "documents").select("doc_id", safe_name(F.split_part("text", F.lit("\n"), F.lit(1)), F.col("doc_id")).alias("name"))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages as paths."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", scalar.last_segment(url).alias("last"), scalar.stem(url).alias("stem"), scalar.with_suffix(url, "_copy").alias("copy"), scalar.mime_type(F.concat(url, F.lit(".PDF"))).alias("mime"))


def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pageloom.operators.annots import csv_field

    return table(spark, sf_dir, "documents").select("doc_id", csv_field(F.col("text")).alias("field"))


def literal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalar.literal_text(F.concat("text", F.lit(" (a\\b)"))).alias("literal"))


def name_swatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", scalar.swatch(F.col("c_name")).alias("swatch"))


def zoom_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    zoom, delta = (F.col("event_id") % 40) / 10.0, ((F.col("user_id") % 21) * 40 - 400).cast("double")
    new = scalar.wheel_zoom(scalar.clamp_zoom(zoom), delta, F.lit(1.25))
    return rounded(table(spark, sf_dir, "events").select("event_id", new.alias("zoom"), scalar.snap_zoom(new).alias("snapped")))


def canonical_reals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalar.canonical_real(F.col("l_extendedprice") / 8).alias("written"))


def font_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as fonts and blocks: mathematical faces and centred blocks by brand."""
    name = F.concat("p_type", F.get(F.array(F.lit(" cmmi10"), F.lit(" CMR10"), F.lit(" Stix")), (F.col("p_partkey") % 3).cast("int")))
    middle = scalar.centred(F.col("p_size") * 12.0, F.col("p_retailprice") / 4, F.lit(300.0), F.lit(600.0))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count_if(scalar.math_font(name)).alias("math"), F.count_if(middle).alias("centred"))


QUERIES = {f.__name__: f for f in (rect_normalise, color_hex, dpi_targets, footprints, watermark_tiles, watermark_points, text_anchor, catmull_segments, eraser_runs, strokes_by_page, template_marks, highlight_boxes, ocr_layout, ocr_totals, crop_and_rotate, aspect_ratio, pdf_date_format, pdf_date_parse, human_bytes, relative_times, safe_filename, path_parts, csv_escape, literal_text, name_swatches, zoom_steps, canonical_reals, font_kinds)}


def _r(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


RECT = """r AS (SELECT vec_id, least(a, c) * 612 AS llx, (1 - greatest(b, d)) * 792 AS lly, greatest(a, c) * 612 AS urx, (1 - least(b, d)) * 792 AS ury FROM (SELECT vec_id, (embedding[1]::DOUBLE + 1) / 2 AS a, (embedding[2]::DOUBLE + 1) / 2 AS b, (embedding[3]::DOUBLE + 1) / 2 AS c, (embedding[4]::DOUBLE + 1) / 2 AS d FROM embeddings))"""
STROKES = """s AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'bezier' ELSE 'pen' END AS tool, CAST(i AS INTEGER) AS ord, (embedding[2 * i + 1]::DOUBLE + 1) / 2 AS x, (embedding[2 * i + 2]::DOUBLE + 1) / 2 AS y FROM embeddings, range(32) t(i))"""


def _shrunk(pixels: str, points: str, dpi: int) -> str:
    return f"CASE WHEN {points} >= 1 AND {pixels} / ({points} / 72) > {dpi} * 1.5 THEN greatest(round({pixels} * ({dpi} / ({pixels} / ({points} / 72)))), 1.0) ELSE {pixels} END"


def _target(name: str, dpi: int, cap: int) -> str:
    w, h = _shrunk("w", "pw", dpi), _shrunk("h", "ph", dpi)
    fit = lambda x, o: f"CASE WHEN greatest({w}, {h}) > {cap} THEN greatest(round({x} * ({cap} / greatest({w}, {h}))), 1.0) ELSE {x} END"
    return f"CAST(greatest(least({fit(w, h)}, w), 1) AS INTEGER) AS {name}_w, CAST(greatest(least({fit(h, w)}, h), 1) AS INTEGER) AS {name}_h"


OCR = "SELECT user_id AS doc_id, event_id % 5 + 1 AS page, event_id AS ord, event_type AS text, {} AS x, {} AS y, {} AS size FROM events WHERE value > 30 AND event_id % 11 <> 0".format(_r("event_id % 10 / 10.0::DOUBLE * 595"), _r("842 - (event_id % 7 / 10.0::DOUBLE + event_id % 3 / 400.0::DOUBLE) * 842"), _r("greatest(event_id % 3 / 400.0::DOUBLE * 842, 4.0)"))
EDGE = lambda c: f"coalesce(lag({c}) OVER w, {c})"
DATE = "['D:' || y || '0231101112Z', y || '1399', 'D:' || y, 'D:19', 'D:' || y || '0010256199+01''00''']"
ZOOM = "greatest(0.25, least(3.0, greatest(0.25, least(3.0, event_id % 40 / 10.0::DOUBLE)) * pow(0.999::DOUBLE, (user_id % 21) * 40 - 400)))"
OLD = "greatest(0.25, least(3.0, event_id % 40 / 10.0::DOUBLE))"
NEW = f"CASE WHEN abs({OLD} - 1.25) >= 0.05 AND abs({ZOOM} - 1.25) < 0.05 THEN 1.25 ELSE {ZOOM} END::DOUBLE"
NAME = r"trim(regexp_replace(string_split(text, chr(10))[1], '[^\p{L}\p{N} \-]', '_', 'g'))"
ORACLES = {
    "rect_normalise": f"WITH {RECT} SELECT vec_id, {_r('llx')} AS llx, {_r('lly')} AS lly, {_r('urx')} AS urx, {_r('ury')} AS ury, {_r('llx / 612')} AS x0, {_r('(792 - ury) / 792')} AS y0, {_r('urx / 612')} AS x1, {_r('(792 - lly) / 792')} AS y1 FROM r",
    "color_hex": "WITH n AS (SELECT vec_id, label + vec_id % 7 AS n FROM embeddings), c AS (SELECT vec_id, CAST(greatest(0, least(255, round(n / 8 * 255::DOUBLE))) AS INTEGER) AS r, CAST(greatest(0, least(255, round((n / 4 - 0.5::DOUBLE) * 255))) AS INTEGER) AS g, CAST(greatest(0, least(255, round((n / 16 + 0.125::DOUBLE) * 255))) AS INTEGER) AS b FROM n) SELECT vec_id, printf('#%02x%02x%02x', r, g, b) AS color, round(r / 255, 6) + 0.0 AS r, round(g / 255, 6) + 0.0 AS g, round(b / 255, 6) + 0.0 AS b FROM c",
    "dpi_targets": f"SELECT p_partkey, {_target('book', 150, 3000)}, {_target('screen', 72, 2000)}, CAST(w AS INTEGER) AS lossless_w, CAST(h AS INTEGER) AS lossless_h FROM (SELECT p_partkey, (p_size * 120)::DOUBLE AS w, (p_size * 90 + p_partkey % 500)::DOUBLE AS h, (p_partkey % 700)::DOUBLE AS pw, p_partkey % 900 / 2.0::DOUBLE AS ph FROM part)",
    "footprints": "SELECT l_partkey, max(l_quantity) AS w, max(l_extendedprice) AS h FROM lineitem GROUP BY l_partkey",
    "watermark_tiles": f"WITH t AS (SELECT r_name, greatest(length(r_name) * 48 * 0.55::DOUBLE * 1.5 + 48, 120) AS sx, 168.0::DOUBLE AS sy FROM region), g AS (SELECT r_name, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, CASE WHEN i % 2 = 0 THEN 0 ELSE sx * 0.5 END - sx * 0.25 + j * sx AS x, sy * 0.5 + i * sy AS y, sx, sy FROM t, range(0, 20) a(i), range(0, 20) b(j)) SELECT r_name, i AS tile_row, j AS tile_col, {_r('x')} AS x, {_r('y')} AS y FROM g WHERE y < 842 + sy AND x < 595 + sx",
    "watermark_points": "SELECT n_name, round(297.5 - w / 2 * cos(radians(45)) - 16 * sin(radians(45)), 6) + 0.0 AS dx, round(421 + w / 2 * sin(radians(45)) - 16 * cos(radians(45)), 6) + 0.0 AS dy, round(297.5 - w / 2, 6) + 0.0 AS cx, 405.0::DOUBLE AS cy FROM (SELECT n_name, length(n_name) * 48 * 0.55::DOUBLE AS w FROM nation)",
    "text_anchor": f"SELECT n_name, position, {_r('''CASE WHEN position LIKE '%left' THEN 36 WHEN position LIKE '%center' THEN 306 - w / 2 ELSE 576 - w END::DOUBLE''')} AS x, CASE WHEN position LIKE 'top%' THEN 756 ELSE 36 END::DOUBLE AS y FROM (SELECT n_name, strlen(n_name) * 6.0::DOUBLE AS w, unnest(['top-left', 'top-center', 'top-right', 'bottom-left', 'bottom-center', 'bottom-right', 'elsewhere']) AS position FROM nation)",
    "catmull_segments": f"WITH {STROKES}, p AS (SELECT vec_id, ord, x, y, coalesce(lag(x) OVER w, x) AS px, coalesce(lag(y) OVER w, y) AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny, coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS fx, coalesce(lead(y, 2) OVER w, lead(y) OVER w) AS fy FROM s WINDOW w AS (PARTITION BY vec_id ORDER BY ord)) SELECT vec_id, CAST(ord + 1 AS INTEGER) AS seg, {_r('x + (nx - px) / 6')} AS c1x, {_r('y + (ny - py) / 6')} AS c1y, {_r('nx - (fx - x) / 6')} AS c2x, {_r('ny - (fy - y) / 6')} AS c2y, {_r('nx')} AS x1, {_r('ny')} AS y1 FROM p WHERE nx IS NOT NULL",
    "eraser_runs": f"WITH {STROKES}, h AS (SELECT *, pow((x - 0.5) * 768, 2) + pow((y - 0.5) * 1000, 2) <= 1600 AS hit FROM s), k AS (SELECT *, bool_or(hit) OVER (PARTITION BY vec_id) AS touched, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY ord) AS run FROM h), r AS (SELECT *, count(*) OVER (PARTITION BY vec_id, run) AS n FROM k WHERE NOT hit AND NOT (touched AND tool = 'bezier')) SELECT vec_id, CAST(dense_rank() OVER (PARTITION BY vec_id ORDER BY run) AS INTEGER) AS fragment, ord, {_r('x')} AS x, {_r('y')} AS y FROM r WHERE NOT touched OR n >= 2",
    "strokes_by_page": "SELECT vec_id % 10 AS page, count(*) AS strokes, count(*) * 32 AS points FROM embeddings GROUP BY 1",
    "template_marks": "SELECT p_partkey, kind, CAST(CASE kind WHEN 'ruled' THEN greatest(ceil((h - 50) / 20), 0) WHEN 'grid' THEN greatest(ceil((h - 20) / 20), 0) + greatest(ceil((w - 20) / 20), 0) WHEN 'dotted' THEN greatest(ceil((h - 30) / 20), 0) * greatest(ceil((w - 30) / 20), 0) ELSE 0 END AS BIGINT) AS marks FROM (SELECT p_partkey, ['ruled', 'grid', 'dotted', 'blank'][p_partkey % 4 + 1] AS kind, p_size * 20.0::DOUBLE AS w, p_size * 30.0::DOUBLE AS h FROM part)",
    "highlight_boxes": f"WITH {STROKES}, b AS (SELECT vec_id, x, floor(y * 10) AS r FROM s) SELECT vec_id, CAST(1 AS INTEGER) AS match, CAST(r * 50 + 25 AS BIGINT) AS band, {_r('min(x)')} AS x0, {_r('r / 10')} AS y0, {_r('max(x) + 0.01')} AS x1, {_r('r / 10 + 0.1')} AS y1 FROM b GROUP BY vec_id, r",
    "ocr_layout": OCR,
    "ocr_totals": f"SELECT doc_id, count(*) AS words FROM ({OCR}) GROUP BY doc_id",
    "crop_and_rotate": f"SELECT p_partkey, {_r('-0.1::DOUBLE * p_size * 10')} AS llx, {_r('(1 - greatest(p_partkey % 10 / 10.0::DOUBLE, 0.9::DOUBLE)) * p_size * 14')} AS lly, {_r('1.2::DOUBLE * p_size * 10')} AS urx, {_r('(1 - least(p_partkey % 10 / 10.0::DOUBLE, 0.9::DOUBLE)) * p_size * 14')} AS ury, (CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 4 - 2) * 90 ELSE 0 END + 270) % 360 AS rotate FROM part",
    "aspect_ratio": f"SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN {_r('p_retailprice / (p_size % 7)')} END AS ratio FROM part",
    "pdf_date_format": "SELECT event_id, strftime(make_timestamp(((epoch_us(ts) // 1000 - CASE WHEN event_id % 3 = 0 THEN 2000000000000 ELSE 0 END) - ((epoch_us(ts) // 1000 - CASE WHEN event_id % 3 = 0 THEN 2000000000000 ELSE 0 END) % 1000 + 1000) % 1000) * 1000), 'D:%Y%m%d%H%M%SZ') AS written FROM events",
    "pdf_date_parse": f"SELECT event_id, {DATE}[event_id % 5 + 1] AS text, CASE event_id % 5 WHEN 0 THEN epoch_ms(make_timestamp(y, 2, 1, 10, 11, 12.0)) + 30 * 86400000::BIGINT WHEN 1 THEN epoch_ms(make_timestamp(y, 12, 31, 0, 0, 0.0)) WHEN 2 THEN epoch_ms(make_timestamp(y, 1, 1, 0, 0, 0.0)) WHEN 4 THEN epoch_ms(make_timestamp(y, 1, 10, 23, 59, 59.0)) END AS millis FROM (SELECT event_id, 1990 + event_id % 40 AS y FROM events)",
    "human_bytes": "SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', floor(n / 1024 * 10 + 0.5) / 10) WHEN n < 1073741824 THEN printf('%.1f MB', floor(n / 1048576 * 10 + 0.5) / 10) ELSE printf('%.2f GB', floor(n / 1073741824 * 100 + 0.5) / 100) END AS size FROM (SELECT doc_id, strlen(text) * (doc_id % 1000 + 1) AS n FROM documents)",
    "relative_times": "SELECT event_id, CASE WHEN g < 60000 THEN 'just now' WHEN g < 3600000 THEN g // 60000 || 'm ago' WHEN g < 86400000 THEN g // 3600000 || 'h ago' WHEN g < 172800000 THEN 'yesterday' ELSE g // 86400000 || 'd ago' END AS ago FROM (SELECT event_id, (SELECT max(epoch_us(ts) // 1000) FROM events) - epoch_us(ts) // 1000 AS g FROM events)",
    "safe_filename": f"SELECT doc_id, CASE WHEN {NAME} = '' THEN 'part' || doc_id ELSE {NAME} END AS name FROM documents",
    "path_parts": r"SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS last, regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1') AS stem, regexp_extract(url, '^(.*?)(\.[^./\\]*)?$', 1) || '_copy' || regexp_extract(url, '^(.*?)(\.[^./\\]*)?$', 2) AS copy, 'application/pdf' AS mime FROM pages",
    "csv_escape": """SELECT doc_id, CASE WHEN regexp_matches(text, '[,"\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS field FROM documents""",
    "literal_text": r"SELECT doc_id, regexp_replace(regexp_replace(text || ' (a\b)', '[^\x20-\x7E]', '', 'g'), '([\\()])', '\\\1', 'g') AS literal FROM documents",
    "name_swatches": "SELECT c_custkey, abs(h) % 10 AS swatch FROM (SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM customer)",
    "zoom_steps": f"SELECT event_id, {_r(NEW)} AS zoom, {_r(f'greatest(0.25, least(3.0, round(({NEW}) / 0.1::DOUBLE) * 0.1::DOUBLE))')} AS snapped FROM events",
    "canonical_reals": r"SELECT l_orderkey, l_linenumber, regexp_replace(printf('%.6f', l_extendedprice / 8), '\.?0+$', '') AS written FROM lineitem",
    "font_kinds": "SELECT p_brand, count(*) FILTER (WHERE regexp_matches(upper(p_type || [' cmmi10', ' CMR10', ' Stix'][p_partkey % 3 + 1]), 'CMMI|CMSY|CMEX|CMBSY|MSAM|MSBM|STIX|EUSM|EUFM|RSFS|MATH|MTMI|MTSY|SYMBOL')) AS math, count(*) FILTER (WHERE abs(p_size * 12.0 - 300) < 24 AND p_retailprice / 4 < 510) AS centred FROM part GROUP BY p_brand",
}
