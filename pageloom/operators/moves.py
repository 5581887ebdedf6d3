"""Logs of moves in a list, played from the first to the last: of tabs, files or pages.

A move does the same to any list of its length, so a stretch of moves is one permutation, and permutations of stretches that
follow one another are joined by looking one up in the other. A log is cut into ranges; each range is played in a task, and
the permutations of a log, one a range, are joined in turn. No log, however long, is played in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.storage import checkpointed, in_place, ship


def play(order: list[int], source: int, target: int) -> None:
    """Takes the item at ``source`` out and puts it back at ``target``, in place; out of range nothing happens."""
    if 0 <= source < len(order) and 0 <= target < len(order):
        order.insert(target, order.pop(source))


def played(moves: DataFrame, sizes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, place, item): what stands at each place after a log's moves; items are their first places, from 0.

    moves: (keys, order, source, target), a total order within keys; sizes: (keys, n), the length of each list. A move out
    of the list or with a null does nothing; a list without moves stays as it is; moves of keys without a size are none.
    ``item``'s ``place`` is where the active one is that began as ``item``.
    """
    ship(moves.sparkSession)
    whole = moves.filter("source is not null and target is not null").join(sizes.select(*keys, "n"), keys)
    placed = in_place(whole.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()))
    by = [*keys, "part"]
    kinds = ", ".join(f"`{c}` {t}" for c, t in placed.select(*by).dtypes)

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, items = None, []
        for batch in batches:
            done = []
            for *key, n, source, target in zip(*(batch[c] for c in (*by, "n", "source", "target")), strict=True):
                if key != at:
                    if at is not None:
                        done.append((*at, items))
                    at, items = key, list(range(n))
                play(items, source, target)
            yield pd.DataFrame(done, columns=[*by, "items"])
        if at is not None:
            yield pd.DataFrame([(*at, items)], columns=[*by, "items"])

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        items: list[int] | None = None
        for own in parts.sort_values("part")["items"]:
            items = list(own) if items is None else [items[i] for i in own]
        return parts[keys].head(1).assign(items=[items])

    one = placed.sortWithinPartitions(*by, *order).mapInPandas(stretches, f"{kinds}, items array<int>")
    kinds = ", ".join(f"`{c}` {t}" for c, t in placed.select(*keys).dtypes)
    last = checkpointed(one.groupBy(*keys).applyInPandas(joined, f"{kinds}, items array<int>"))
    all_ = sizes.select(*keys, "n").join(last, keys, "left")
    items = F.coalesce("items", F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n").cast("int") - 1)).otherwise(F.array().cast("array<int>")))
    return all_.select(*keys, F.posexplode(items).alias("place", "item"))


def final_order(tabs: DataFrame, moves: DataFrame, active: DataFrame, keys: list[str], order: list[str], item: str) -> DataFrame:
    """(keys, place, item, active) of (keys, place, item) tabs after their moves: the active tab stays active wherever it goes.

    active: (keys, place), at most one a list. Places count from 0 without gaps.
    """
    sizes = tabs.groupBy(*keys).agg(F.count("*").alias("n"))
    last = played(moves, sizes, keys, order).withColumnsRenamed({"item": "from"})
    began = tabs.select(*keys, F.col("place").cast("int").alias("from"), item)
    on = active.select(*keys, F.col("place").cast("int").alias("from"), F.lit(True).alias("active"))
    return last.join(began, [*keys, "from"]).join(on, [*keys, "from"], "left").select(*keys, "place", item, F.coalesce("active", F.lit(False)).alias("active"))
