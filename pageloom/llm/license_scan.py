"""Licence scans: windows of a text against licence templates by Dice coefficient over word bigrams.

Text and templates are normalised to lower-case words of letters and digits. The Dice coefficient of a window of n
bigrams and a template of m is 2 c / (n + m), c being the bigrams that they share, each counted as often as in the one
that has it less often; a copy scores 1. It can reach t only if c is t m / (2 - t) or more and n is (2 - t) m / t or
less. A document whose shared bigrams are too few anywhere is not compared with that template. Of all windows of a
length within the bounds the best is found; it begins and ends at bigrams of the template, so only those are tried. A
bigram counts in a window if the window holds, before it, fewer of its kind than the template: if it starts after the
place where that many others stand.
DataFrame functions only, and no shuffle: templates are few and go along as literals.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES

#: Distinct bigrams of all templates together; they are literals of the plan.
MOST_BIGRAMS = 50_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def bigrams(column: str) -> Column:
    """Hashes of the neighbouring pairs of an array of words."""
    n = F.greatest(F.size(column) - 1, F.lit(0))
    return F.zip_with(F.slice(column, 1, n), F.slice(column, 2, n), lambda a, b: F.xxhash64(a, b))


def longs(values: Sequence[int], kind: str = "bigint") -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def template_bigrams(spark: SparkSession, templates: Sequence[tuple[str, str, str]]) -> list[dict[int, int]]:
    """How often each template has each of its bigrams; the collected rows are the templates given, not data."""
    source = spark.range(1).select(F.posexplode(F.array(*[F.lit(t) for _, _, t in templates])).alias("at", "text"))
    rows = source.select("at", words(F.col("text")).alias("words")).select("at", bigrams("words").alias("bigrams")).orderBy("at").collect()
    found = [{h: r.bigrams.count(h) for h in r.bigrams} for r in rows]
    if not all(found) or sum(map(len, found)) > MOST_BIGRAMS:
        raise ValueError("each template needs two words at least, and all together no more than MOST_BIGRAMS bigrams")
    return found


def fewest(grams: dict[int, int], need: int) -> int:
    """The fewest distinct bigrams of a template that make up so many."""
    return 1 + sum(total < need for total in itertools.accumulate(sorted(grams.values(), reverse=True)))


def hits() -> Column:
    """(g, p) of the template's bigrams in the text, by bigram and place."""
    there = F.filter(F.transform("grams", lambda h, i: F.struct(h.alias("g"), i.alias("p"))), lambda x: F.array_contains("wanted", x["g"]))
    return F.sort_array(there)


def placed() -> Column:
    """(p, before) by place: a window that starts at ``before`` or earlier is full of p's bigram without p; -1: none is."""

    def before(x: Column, r: Column) -> Column:
        full = F.get("sorted", r - F.get("times", (F.array_position("wanted", x["g"]) - 1).cast("int")))
        return F.struct(x["p"].alias("p"), F.when(full["g"] == x["g"], full["p"]).otherwise(-1).alias("before"))

    return F.sort_array(F.transform("sorted", before))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license_id, template, dice, first_word, n_words): the best window of each document for each template it matches.

    template is the template's place in the list, first_word the window's first word, counted from 0, n_words its
    length; of equally good windows the first, then the shortest. dice is rounded to 6 places and at least the
    threshold. A text close to several templates matches each of them. Null, empty or one-word texts match nothing.
    Rows are judged one by one: repeated rows repeat, a null key stays null; an empty table gives no rows. Extra columns
    are not read. A text of H bigrams of a template with m takes about H m steps.
    """
    grams = template_bigrams(docs.sparkSession, templates)
    sizes = [sum(g.values()) for g in grams]
    need = [math.ceil(round(threshold * m / (2 - threshold), 9)) for m in sizes]
    distinct = [fewest(g, n) for g, n in zip(grams, need, strict=True)]
    everything = longs(sorted({h for g in grams for h in g}))
    read = docs.select(F.col(key).alias("key"), words(F.col(text)).alias("words"))
    read = read.select("key", bigrams("words").alias("grams")).filter(F.size("grams") >= min(need))
    read = read.withColumn("shared", F.array_intersect("grams", everything)).filter(F.size("shared") >= min(distinct))
    fits = [F.when((F.size("grams") >= n) & (F.size("shared") >= d) & (F.size(F.array_intersect("shared", longs(list(g)))) >= d), F.lit(i)) for i, (g, n, d) in enumerate(zip(grams, need, distinct, strict=True))]
    pairs = read.select("key", "grams", F.explode(F.filter(F.array(*fits), lambda i: i.isNotNull())).alias("template"))
    of = lambda values: F.get(F.array(*values), F.col("template"))
    longest = [math.floor(round((2 - threshold) * m / threshold, 9)) for m in sizes]
    pairs = pairs.select("*", of([longs(list(g)) for g in grams]).alias("wanted"), of([longs(list(g.values()), "int") for g in grams]).alias("times"))
    pairs = pairs.select("*", of(map(F.lit, sizes)).alias("m"), of(map(F.lit, need)).alias("need"), of(map(F.lit, longest)).alias("longest"))
    kept = ("key", "template", "m", "need", "longest")
    pairs = pairs.select(*kept, "wanted", "times", F.explode(F.array(hits())).alias("sorted"))  # explode: worked out once
    pairs = pairs.select(*kept, F.explode(F.array(placed())).alias("placed"))
    pairs = pairs.filter(F.size(F.filter("placed", lambda x: x["before"] < 0)) >= F.col("need"))
    near = F.filter(F.sequence(F.lit(0), F.size("placed") - F.col("need")), lambda s: F.get("placed", s + F.col("need") - 1)["p"] - F.get("placed", s)["p"] < F.col("longest"))

    def best_from(s: Column) -> Column:
        first = F.get("placed", s)["p"]
        counted = F.filter(F.slice("placed", s + 1, F.col("longest")), lambda x: (x["before"] < first) & (x["p"] - first < F.col("longest")))
        length = lambda x: x["p"] - first + 1
        return F.array_max(F.transform(counted, lambda x, k: F.struct((2 * (k + 1) / (length(x) + F.col("m"))).alias("dice"), (-first).alias("minus"), (-length(x)).alias("less"))))

    found = pairs.select("key", "template", F.array_max(F.transform(near, best_from)).alias("best")).filter(F.col("best.dice") >= threshold - 1e-9)
    names = F.array(*[F.lit(name) for name, _, _ in templates])
    return found.select(
        F.col("key").alias(key),
        F.get(names, F.col("template")).alias("license_id"),
        F.col("template").cast("int").alias("template"),
        F.round("best.dice", 6).alias("dice"),
        (-F.col("best.minus")).cast("int").alias("first_word"),
        (1 - F.col("best.less")).cast("int").alias("n_words"),
    )
