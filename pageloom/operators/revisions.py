"""A file's chain of cross-reference sections, from the newest back, and the entries that count."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.storage import checkpointed, ship, written

#: Sections of a chain. Fixed value.
MOST_SECTIONS = 512


class Chain(NamedTuple):
    """sections: (doc, offset, rank, stm), rank 0 the newest; errors: (doc, error) of documents that have no chain."""

    sections: DataFrame
    errors: DataFrame


def chain(sections: DataFrame, starts: DataFrame, most: int = MOST_SECTIONS) -> Chain:
    """The sections that (doc, offset) ``starts`` lead to over (doc, offset, prev, stm) rows, in order.

    A chain that comes back to one of its sections ends there. A document is an error if its chain has more than ``most``
    sections, or if a section or the stream table that it names is missing. Sections are sorted and cut into units, wherever
    that cuts a document; a task follows all ways of a unit at once to where they leave it. What is left are the sections
    that a chain enters a unit by: they get their ranks by pointer doubling, and their units the ranks of the others.
    """
    ship(sections.sparkSession)
    links = sections.select("doc", "offset", "prev", "stm").filter("doc is not null and offset is not null").dropDuplicates(["doc", "offset"])
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("prev", "stm")]
    flat = links.select("doc", F.col("offset").cast("long").alias("offset"), *filled, F.col("prev").isNotNull().alias("led"), F.col("stm").isNotNull().alias("packed"))
    sorted_ = flat.hint("rebalance", "doc").sortWithinPartitions("doc", "offset")
    named = ", ".join(f"`{c}` {t}" for c, t in flat.dtypes)
    units = written(sorted_.mapInPandas(followed, f"{named}, here boolean, unit long, leaves boolean, exit long, hops long"))
    begins = starts.select("doc", F.col("offset").cast("long").alias("offset"), F.lit(0).cast("long").alias("rank")).dropDuplicates(["doc"])
    known = checkpointed(begins)
    entered = units.filter("leaves").select("doc", F.col("exit").alias("offset")).unionByName(known.select("doc", "offset")).distinct()
    heads = checkpointed(entered.join(units.select("doc", "offset", "unit", "leaves", "exit", "hops"), ["doc", "offset"]))
    jumps = heads.filter("leaves").select("doc", "offset", F.col("exit").alias("to"), "hops")
    for _ in range(most.bit_length() + 1):
        further = known.join(jumps, ["doc", "offset"]).select("doc", F.col("to").alias("offset"), (F.col("rank") + F.col("hops")).alias("rank"))
        further = checkpointed(further.filter(F.col("rank") <= most))
        if further.isEmpty():
            break
        known = checkpointed(known.unionByName(further).groupBy("doc", "offset").agg(F.min("rank").alias("rank")))
        twice = jumps.select("doc", F.col("offset").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        jumps = checkpointed(jumps.join(twice, ["doc", "to"]).select("doc", "offset", F.col("next").alias("to"), (F.col("hops") + F.col("more")).alias("hops")))
    placed = checkpointed(known.join(heads.select("doc", "offset", "unit"), ["doc", "offset"], "left"))
    none, no = F.lit(0).cast("long"), F.lit(False)
    tagged = placed.filter("unit is not null").select("doc", "offset", none.alias("prev"), none.alias("stm"), no.alias("led"), no.alias("packed"), no.alias("here"), "unit", "rank")
    rows = units.select(*flat.columns, "here", "unit", F.lit(-1).cast("long").alias("rank")).unionByName(tagged)
    ranked = rows.groupBy("unit").applyInPandas(spread(most), f"{named}, here boolean, rank long")
    ranked = ranked.select("doc", "offset", "rank", F.when(F.col("packed"), F.col("stm")).alias("stm"), "here", F.lit(False).alias("gone"))
    missing = placed.filter("unit is null").select("doc", "offset", "rank", F.lit(None).cast("long").alias("stm"), F.lit(True).alias("here"), F.lit(True).alias("gone"))
    found = written(ranked.unionByName(missing))
    elsewhere = found.filter("stm is not null and not here").select("doc", F.col("stm").alias("offset")).distinct()
    absent = elsewhere.join(units.select("doc", "offset"), ["doc", "offset"], "left_anti").select("doc").distinct().withColumn("absent", F.lit(True))
    told = found.groupBy("doc").agg(F.count("*").alias("n"), F.bool_or("gone").alias("gone")).join(absent, "doc", "left")
    error = F.when(F.col("n") > most, F.lit(f"the chain has more than {most} sections")).when(F.col("gone") | F.col("absent"), F.lit("a section is missing"))
    errors = checkpointed(told.select("doc", error.alias("error")).filter("error is not null"))
    types = dict(sections.dtypes)
    typed = [F.col(c).cast(types[c]).alias(c) for c in ("offset", "stm")]
    return Chain(found.select("doc", typed[0], "rank", typed[1]).join(errors, "doc", "left_anti"), errors)


def places(rows: pd.DataFrame, docs: pd.Series, *asked: pd.Series) -> list[np.ndarray]:
    """For each series of offsets, of the documents ``docs``, the rows of (doc, offset) that have them; -1 where none has."""
    doc, _ = pd.factorize(pd.concat([rows["doc"], docs], ignore_index=True))
    offset, _ = pd.factorize(np.concatenate([rows["offset"], *asked]))
    own = doc[: len(rows)] * len(offset) + offset[: len(rows)]
    order = np.argsort(own, kind="stable")
    found, at = [], len(rows)
    for part in asked:
        want = doc[len(rows) :] * len(offset) + offset[at : at + len(part)]
        at += len(part)
        near = order[np.minimum(np.searchsorted(own[order], want), len(rows) - 1)]
        found.append(np.where(own[near] == want, near, -1))
    return found


def followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each batch is a unit: whether its rows' ways leave it, the first section beyond and the steps to it; whether it holds the stream table."""
    part = TaskContext.get().partitionId()
    for n, rows in enumerate(batches):
        if rows.empty:
            continue
        prev, stm = places(rows, rows["doc"], rows["prev"], rows["stm"])
        prev = np.where(rows["led"], prev, -1)
        end, hops = np.where(prev >= 0, prev, np.arange(len(rows))), (prev >= 0).astype("int64")
        for _ in range(len(rows).bit_length()):
            end, hops = end[end], hops + hops[end]
        leaves = (prev[end] < 0) & rows["led"].to_numpy()[end]
        yield rows.assign(here=stm >= 0, unit=(part << 32) + n, leaves=leaves, exit=rows["prev"].to_numpy()[end], hops=hops + 1)


def spread(most: int):
    """The rows of a unit that its ranked entries lead to, with their ranks."""

    def of(both: pd.DataFrame) -> pd.DataFrame:
        rows, entries = both[both["rank"] < 0].reset_index(drop=True), both[both["rank"] >= 0]
        (prev,) = places(rows, rows["doc"], rows["prev"])
        prev = np.where(rows["led"], prev, -1)
        rank = np.full(len(rows), most + 1)
        np.minimum.at(rank, places(rows, entries["doc"], entries["offset"])[0], entries["rank"].to_numpy())
        for k in range(most.bit_length()):
            on = np.flatnonzero((rank <= most) & (prev >= 0))
            if not len(on):
                break
            np.minimum.at(rank, prev[on], rank[on] + (1 << k))
            prev = np.where(prev >= 0, prev[prev], -1)
        return rows.drop(columns="unit").assign(rank=rank)[rank <= most]

    return of


def newest(found: Chain, entries: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(doc, keys, values): of the entries (doc, offset, keys, values) of each document's sections the newest of each key.

    The entries of a section's stream table beat the section's own; of equal ones in one section the least values count.
    Trailer entries merge alike, with their name as the key.
    """
    own = found.sections.select("doc", "offset", "rank", F.lit(1).alias("table"))
    streams = found.sections.filter("stm is not null").select("doc", F.col("stm").alias("offset"), "rank", F.lit(0).alias("table"))
    met = entries.join(own.unionByName(streams), ["doc", "offset"])
    best = met.groupBy("doc", *keys).agg(F.min(F.struct("rank", "table", *values)).alias("best"))
    return best.select("doc", *keys, *[f"best.{v}" for v in values])
