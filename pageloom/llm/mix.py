"""Mixing sources to target weights, to the exact word.

Each row gets a hash-random key, of its id and text, so that rows without an id do not meet in one place. Within a source, rows are ordered by that key; the running sum of their sizes tells
where the source's budget ends. The running sum is built in two levels, so that no task holds a whole source: keys fall
into about sqrt(n) equal ranges, range sums are added up first, and rows are sorted and added up within one range.
A budget above the source's size is met by whole further passes (epochs) and a cut in the last one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, free_name, hex_key, without

KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_order(source: Column) -> Column:
    """A text that is never null and sorts as the sources by code point, null last."""
    return F.when(source.isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], ratio: float, most: float) -> DataFrame:
    """Targets of (mix_source, source_size) rows: a weighted share of ratio x all sizes, at most ``most`` x the own size.

    Sources may be many: they are ranked by a range partitioning and never collected. Each round of the loop brings
    back three numbers; a round fixes at least one more source at its limit, in practice a handful of rounds do.
    """
    placed = checkpoint(sizes.repartitionByRange("mix_source").sortWithinPartitions("mix_source").withColumn("mix_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("mix_at", 33), F.col("mix_at").bitwiseAND((1 << 33) - 1)
    before = placed.groupBy(part.alias("mix_part")).agg(F.count("*").alias("n"))  # a row a partition
    before = before.select("mix_part", (F.sum("n").over(Window.orderBy("mix_part")) - F.col("n")).alias("mix_before"))
    choice = F.array(*[F.lit(float(w)) for w in weights])
    ranked = placed.withColumn("mix_part", part).withColumn("mix_place", place).join(F.broadcast(before), "mix_part")
    rank = (F.col("mix_before") + F.col("mix_place")) % len(weights)
    ranked = checkpoint(ranked.select("mix_source", "source_size", F.get(choice, rank.cast("int")).alias("mix_weight")))
    limit = F.col("source_size") * F.lit(float(most))
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * float(ratio)
    level, capped = None, -1
    while True:
        at_limit = F.lit(False) if level is None else F.col("mix_weight") * level > limit
        n, spent, weight = ranked.agg(F.count_if(at_limit), F.sum(F.when(at_limit, limit)), F.sum(F.when(~at_limit, F.col("mix_weight")))).first()
        if n == capped or not weight:
            break
        level, capped = (total - (spent or 0.0)) / weight, n
    share = limit if level is None else F.least(F.col("mix_weight") * level, limit)
    return ranked.select("mix_source", "source_size", share.cast("double").alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), ratio: float = 1.5, most: float = 2.0, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target (its source's) and taken: the words that the mix takes of this row.

    Sources by code point, null (a source of its own) last, get the weights in turn. A source's target is its share of
    ratio x all words, at most ``most`` x its own; taken sums to the floor of the target in every source. A row's words
    are taken 0, 1 or more whole times, and in one row a source only in part. Null or empty texts have size 0 and give
    nothing; rows with equal keys are ordered by size and text hash, and equal rows may stand for one another. An empty
    table stays empty. Columns named size, source_size, target or taken are replaced.
    """
    named = ["size", "source_size", "target", "taken"]
    kept = without(docs.columns, *named)
    by, order, span, tie = (free_name(kept, n) for n in ("mix_source", "mix_key", "mix_range", "mix_tie"))
    sized = docs.select(
        *kept,
        word_count(F.col(text)).alias("size"),
        source_order(F.col(source)).alias(by),
        hex_key(seed + ":", F.coalesce(F.col(key).cast("string"), F.lit("")), ":", F.coalesce(F.col(text), F.lit(""))).alias(order),
        F.xxhash64(text).alias(tie),
    )
    ranges = max(1, math.isqrt(docs.count()))
    sized = sized.withColumn(span, F.floor(F.col(order) / F.lit(float(1 << KEY_BITS)) * ranges).cast("long"))
    sums = checkpoint(sized.groupBy(F.col(by).alias("mix_source"), F.col(span).alias("mix_range")).agg(F.sum("size").alias("mix_sum")))
    targets = source_targets(sums.groupBy("mix_source").agg(F.sum("mix_sum").alias("source_size")), weights, ratio, most)
    upto = Window.partitionBy("mix_source").orderBy("mix_range")
    starts = sums.join(targets, "mix_source").withColumn("mix_start", F.sum("mix_sum").over(upto) - F.col("mix_sum"))
    begin = free_name(kept, "mix_start")
    starts = starts.select(F.col("mix_source").alias(by), F.col("mix_range").alias(span), F.col("mix_start").alias(begin), "source_size", "target")
    rows = sized.join(checkpoint(starts), [by, span])
    inside = Window.partitionBy(by, span).orderBy(order, F.col(key), "size", tie)
    start = F.col(begin) + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest - start))
    return rows.withColumn("taken", taken.cast("long")).select(*kept, *named)


def mixed_rows(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of a mix themselves: one a pass, the last cut to its words (then joined by single spaces), n_chars renewed."""
    kept, nth = without(mixed.columns, "size", "source_size", "target", "taken"), free_name(mixed.columns, "mix_pass")
    passes = mixed.filter("taken > 0").withColumn(nth, F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col(nth) - 1) * F.col("size")
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), 1, F.greatest(left, F.lit(1)).cast("int")))
    out = passes.withColumn(text, F.when(left < F.col("size"), cut).otherwise(F.col(text)))
    if "n_chars" in kept:
        out = out.withColumn("n_chars", F.when(left < F.col("size"), F.length(text)).otherwise(F.col("n_chars")).cast(mixed.schema["n_chars"].dataType))
    return out.select(*kept)
