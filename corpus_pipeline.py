"""A training corpus from raw documents: toxic rows go, near copies go, benchmark leaks go; the rest is mixed and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.llm import decontaminate, mix, near_copies, shard, toxicity
from pageloom.llm.common import free_name, read, remove, without, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from all labelled documents at hand, does not call toxic."""
    lexicon = toxicity.learn_lexicon(docs, read(spark, sf_dir, "labels"))
    aside = set_aside(docs, "score", "predicted")
    clean = toxicity.score_toxicity(docs.withColumnsRenamed(aside), lexicon).filter("predicted = 0").drop("score", "predicted")
    return put_back(clean, aside, docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the least doc_id, null last, then the least text hash.

    Near duplicates have a Jaccard similarity of 0.8 or more over the shingles of five words, or are joined by such links.
    Rows are told apart by id and text, so repeated ids and null ids are judged by their texts; equal rows become one.
    """
    shifted = F.col("doc_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")  # so that negative ids sort as numbers
    number = F.when(F.col("doc_id").isNull(), F.lit("~")).otherwise(F.lpad(shifted.cast("string"), 20, "0"))
    mark = free_name(docs.columns, "mark")
    marked = docs.withColumn(mark, F.concat(number, F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    groups = written(near_copies.near_copies(marked.select(F.col(mark).alias("mark"), F.col("text").cast("string").alias("text"))))
    named = [groups.filter(which).select(F.col("mark").alias(mark)) for which in ("mark <> component", "mark = component and rows > 1")]
    gone, repeated = map(written, named)
    return near_copies.one_each(marked.join(gone, mark, "left_anti"), mark, repeated).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.without_overlaps(docs, read(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes: documents past their source's budget go, those that it repeats come twice, one is cut."""
    aside = set_aside(docs, "size", "source_size", "target", "taken")
    return put_back(mix.mixed_rows(mix.mix_sources(docs.withColumnsRenamed(aside))), aside, docs.columns)


def place_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard; a column of that name is replaced, all others stay."""
    aside = set_aside(docs, "slot")
    placed = shard.assign_shards(docs.withColumnsRenamed(aside)).drop("slot")
    return put_back(placed, aside, [*without(docs.columns, "shard"), "shard"])


def set_aside(docs: DataFrame, *names: str) -> dict[str, str]:
    """Free names for the columns that an operator would replace, by the names that they have."""
    aside: dict[str, str] = {}
    for column in docs.columns:
        if column.lower() in names:
            aside[column] = free_name([*docs.columns, *names, *aside.values()], column)
    return aside


def put_back(docs: DataFrame, aside: dict[str, str], columns: list[str]) -> DataFrame:
    return docs.withColumnsRenamed({free: column for column, free in aside.items()}).select(*columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("mix_sources", mix_to_weights),
    ("sharding", place_shards),
]

#: The lexicon, the SimHash groups and the order of the mix are beyond SQL; tests/llm holds stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        remove(before)
    return docs
