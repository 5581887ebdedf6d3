"""Queries on page content as rows of operators, made of the order tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.operators import content, documents
from pageloom.plans.documents import _cut, _plan
from pageloom.sources.tables import table
from pageloom.storage import checkpointed

DOCS = 25


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines numbered within their order; an order is a content of one of DOCS documents."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return checkpointed(rows.select((F.col("l_orderkey") % DOCS).alias("doc"), F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), n.alias("n")))


def operators(rows: DataFrame) -> DataFrame:
    """A line saves the matrix, changes it, draws, and restores it: not at all, once or twice. Every tenth part lacks a number."""
    p, s, n = F.col("p"), F.col("s"), F.col("n")
    x, y, zero = F.pow(F.lit(2.0), p % 3 - 1), F.pow(F.lit(2.0), s % 3 - 1), F.lit(0.0)
    numbers = F.when(n % 2 == 1, F.array(x, zero, zero, y, p.cast("double"), zero)).otherwise(F.array(zero, x, -y, zero, zero, zero))
    numbers = F.when(p % 10 == 0, F.slice(numbers, 1, 5)).otherwise(numbers)
    name = F.when(n % 3 == 0, F.lit("F")).otherwise(F.concat(F.lit("P"), p.cast("string")))

    def step(op: str, numbers: Column | None = None, name: Column | None = None) -> Column:
        none = F.lit(None).cast("array<double>"), F.lit(None).cast("string")
        return F.struct(F.lit(op).alias("op"), (none[0] if numbers is None else numbers).alias("numbers"), (none[1] if name is None else name).alias("name"))

    restored = F.when(s % 4 == 0, F.array(step("f"))).when(s % 4 == 1, F.array(step("Q"), step("Q"))).otherwise(F.array(step("Q")))
    steps = F.concat(F.array(step("q"), step("cm", numbers), step("Do", None, name)), restored)
    return rows.select("doc", order_name("k").alias("content"), n.alias("line"), F.posexplode(steps).alias("at", "step")).select("doc", "content", (F.col("line") * 10 + F.col("at")).alias("ord"), "step.*")


def order_name(key: str | Column) -> Column:
    return F.concat(F.lit("o"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def drawn(rows: DataFrame) -> DataFrame:
    """Footprints of the parts that the pages draw: every fifth order is a page, the third lines draw other orders as forms."""
    part, form = F.concat(F.lit("p"), F.col("p").cast("string")), order_name(F.when(F.col("k") % 4 == 0, F.col("k") - 2 * DOCS).otherwise(F.col("k") + DOCS))
    of_part, of_form = rows.filter("n % 3 <> 0"), rows.filter("n % 3 = 0")
    names = of_part.select("doc", order_name("k").alias("content"), F.concat(F.lit("P"), F.col("p").cast("string")).alias("name"), part.alias("target"))
    resources = names.unionByName(of_form.select("doc", order_name("k").alias("content"), F.lit("F").alias("name"), form.alias("target")))  # a name may come twice
    mask = F.when(F.col("p") % 4 == 0, F.concat(F.lit("m"), F.col("p").cast("string")))
    images = rows.select("doc", "p").distinct().select("doc", part.alias("id"), F.lit("Image").alias("kind"), F.lit(None).cast("array<double>").alias("matrix"), mask.alias("mask"))
    matrix = F.when(F.col("k") % 3 == 0, F.array(*map(F.lit, (2.0, 0.0, 0.0, 0.5, 0.0, 0.0)))).when(F.col("k") % 3 == 1, F.array(F.lit(7.0), F.lit(0.0)))
    orders = rows.select("doc", "k").distinct()
    forms = orders.select("doc", order_name("k").alias("id"), F.lit("Form").alias("kind"), matrix.alias("matrix"), F.lit(None).cast("string").alias("mask"))
    pages = orders.filter("k % 5 = 0").select("doc", order_name("k").alias("content"))
    return content.placements(operators(rows), resources, images.unionByName(forms), pages)


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(lines(spark, sf_dir))


def placed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes to code the parts of each document in, by the largest footprint on its pages."""
    rows = lines(spark, sf_dir)
    sizes = drawn(rows).select(F.concat_ws("/", F.col("doc").cast("string"), "image").alias("image_id"), (F.col("w") * 100).alias("w"), (F.col("h") * 100).alias("h"))
    parts = rows.select("doc", "p").distinct()
    key = F.concat_ws("/", F.col("doc").cast("string"), F.concat(F.lit("p"), F.col("p").cast("string")))
    p = F.col("p")
    images = parts.select(key.alias("image_id"), (p % 9 * 400).cast("int").alias("width"), (p % 20 * 300).cast("int").alias("height"), F.when(p % 7 == 0, 1).otherwise(8).alias("bits"), (p % 11 == 0).alias("mask"), (p % 2 == 0).alias("dct"), (p % 3 > 0).alias("supported"))
    return documents.image_plans(images, sizes)


QUERIES = {f.__name__: f for f in (placements, placed_images)}

_TIMES = "[{m}[1] * {n}[1] + {m}[2] * {n}[3], {m}[1] * {n}[2] + {m}[2] * {n}[4], {m}[3] * {n}[1] + {m}[4] * {n}[3], {m}[3] * {n}[2] + {m}[4] * {n}[4]]"
_DRAWN = f"""l AS (
  SELECT l_orderkey % 25 AS doc, l_orderkey AS k, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem
), m AS (
  SELECT *, CASE WHEN p % 10 = 0 THEN NULL WHEN n % 2 = 1 THEN [2.0::DOUBLE ** (p % 3 - 1), 0, 0, 2.0::DOUBLE ** (s % 3 - 1)] ELSE [0, 2.0::DOUBLE ** (p % 3 - 1), -(2.0::DOUBLE ** (s % 3 - 1)), 0] END AS m FROM l
), w AS (
  SELECT k, 0::BIGINT AS n, [1, 0, 0, 1]::DOUBLE[] AS ctm, []::DOUBLE[][] AS stack, NULL::DOUBLE[] AS cur FROM (SELECT DISTINCT k FROM l)
  UNION ALL
  SELECT k, n, CASE WHEN s % 4 = 0 THEN cur WHEN s % 4 = 1 AND len(stack) > 0 THEN stack[-1] ELSE ctm END,
         CASE WHEN s % 4 = 0 THEN list_append(stack, ctm) WHEN s % 4 = 1 THEN stack[1:len(stack) - 1] ELSE stack END, cur
  FROM (SELECT w.k, m.n, m.s, w.ctm, w.stack, CASE WHEN m.m IS NULL THEN w.ctm ELSE {_TIMES.format(m="m.m", n="w.ctm")} END AS cur FROM w JOIN m ON m.k = w.k AND m.n = w.n + 1)
), d AS MATERIALIZED (
  SELECT DISTINCT l.doc, l.k, l.n % 3 = 0 AS form, CASE WHEN l.n % 3 <> 0 THEN l.p WHEN l.k % 4 = 0 THEN l.k - 50 ELSE l.k + 25 END AS target, w.cur FROM w JOIN l ON w.k = l.k AND w.n = l.n
), f AS (
  SELECT doc, k, [1, 0, 0, 1]::DOUBLE[] AS ctm, []::BIGINT[] AS inside, 0 AS depth FROM (SELECT DISTINCT doc, k FROM l WHERE k % 5 = 0)
  UNION
  SELECT doc, target, CASE WHEN target % 3 = 0 THEN [2.0::DOUBLE * cur[1], 2.0::DOUBLE * cur[2], 0.5::DOUBLE * cur[3], 0.5::DOUBLE * cur[4]] ELSE cur END, inside, depth FROM (
    SELECT f.doc, d.target, {_TIMES.format(m="d.cur", n="f.ctm")} AS cur, list_sort(list_append(f.inside, d.target)) AS inside, f.depth + 1 AS depth
    FROM f JOIN d ON d.doc = f.doc AND d.k = f.k WHERE d.form AND f.depth + 1 < 12 AND NOT list_contains(f.inside, d.target) AND d.target IN (SELECT k FROM l))
), i AS (
  SELECT doc, target AS p, max(sqrt(cur[1] * cur[1] + cur[2] * cur[2])) AS w, max(sqrt(cur[3] * cur[3] + cur[4] * cur[4])) AS h
  FROM (SELECT f.doc, d.target, {_TIMES.format(m="d.cur", n="f.ctm")} AS cur FROM f JOIN d ON d.doc = f.doc AND d.k = f.k WHERE NOT d.form) GROUP BY ALL
), drawn AS (
  SELECT doc, 'p' || p AS image, w, h FROM i UNION ALL SELECT doc, 'm' || p, w, h FROM i WHERE p % 4 = 0
)"""
ORACLES = {
    "placements": f"WITH RECURSIVE {_DRAWN} SELECT * FROM drawn",
    "placed_images": f"""WITH RECURSIVE {_DRAWN}, i2 AS (
      SELECT doc || '/p' || p AS image_id, (p % 9 * 400)::DOUBLE AS pw, (p % 20 * 300)::DOUBLE AS ph, p % 2 = 0 AS dct, coalesce(w * 100, 0) AS dw, coalesce(h * 100, 0) AS dh
      FROM (SELECT DISTINCT doc, p FROM l) LEFT JOIN i USING (doc, p)
      WHERE p % 11 <> 0 AND p % 7 <> 0 AND p % 9 > 0 AND p % 20 > 0 AND (p % 3 > 0 OR p % 2 = 0)
    ), s AS (SELECT image_id, dct, pw, ph, {_plan('pw', 'dw')} AS w, {_plan('ph', 'dh')} AS h FROM i2),
    t AS (SELECT image_id, dct, pw, ph, CAST(greatest(least({_cut('w')}, pw), 1) AS INTEGER) AS target_w, CAST(greatest(least({_cut('h')}, ph), 1) AS INTEGER) AS target_h FROM s)
    SELECT image_id, target_w, target_h FROM t WHERE NOT dct OR target_w <> pw OR target_h <> ph""",
}
