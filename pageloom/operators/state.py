"""State kept as event logs: settings, a library, tabs, caches, recent lists. The current state is a fold of the log.

Where only the last write of a key counts, the fold is an aggregation. Where an entry's fate hangs on what came before
(a bounded cache), an owner's events are walked in order in one task, which holds the cache and nothing else of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators.sums import sum_before


def upsert_latest(log: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """The last written values of each key."""
    at = F.struct(*order)
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*values), at).alias("row"))
    return last.select(*keys, "row.*")


def library_state(log: DataFrame) -> DataFrame:
    """(path, name, starred, archived, added_at) of (path, name, flag, on, ts, seq) events.

    Each flag keeps its own last write, the name is that of the last event, added_at that of the first; an unset flag is off.
    """
    at = F.struct("ts", "seq")
    on = lambda flag: F.coalesce(F.max_by("on", F.when(F.col("flag") == flag, at)), F.lit(False))
    return log.groupBy("path").agg(F.max_by("name", at).alias("name"), on("starred").alias("starred"), on("archived").alias("archived"), F.min_by("ts", at).alias("added_at"))


def flagged(library: DataFrame, flag: str) -> DataFrame:
    """Rows with the flag, newest first, ties by path."""
    return library.filter(F.col(flag)).orderBy(F.desc("added_at"), "path")


def lookup(table: DataFrame, wanted: DataFrame, keys: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """Every wanted key with its row; where there is none the defaults, or nulls."""
    found = wanted.join(table, keys, "left")
    return found.fillna(defaults) if defaults else found


def tab_session(log: DataFrame) -> DataFrame:
    """(session, position, path, active) of the last saved session: (session, save_no, position, path, is_active) rows.

    Saving replaces all. One tab is active: the last one marked, else the first.
    """
    last = log.groupBy("session").agg(F.max("save_no").alias("save_no"))
    rows = log.join(last, ["session", "save_no"])
    everything = Window.partitionBy("session")
    active = F.coalesce(F.max(F.when(F.col("is_active"), F.col("position"))).over(everything), F.lit(0))
    return rows.select("session", "position", "path", (F.col("position") == active).alias("active"))


def recent(log: DataFrame, owner: list[str], item: str, order: list[str], k: int) -> DataFrame:
    """(owner, rank, item): the k last used distinct items, newest first."""
    last = log.groupBy(*owner, item).agg(F.max(F.struct(*order)).alias("last"))
    rank = F.row_number().over(Window.partitionBy(*owner).orderBy(F.desc("last"), item))
    return last.select(*owner, rank.alias("rank"), item).filter(F.col("rank") <= k)


def folded(log: DataFrame, owner: list[str], order: list[str], event: list[str], step: Callable[..., None]) -> DataFrame:
    """(owner, keys): a fold of each owner's events in order; ``step(state, *event)`` changes a list of texts in place.

    Events are sorted by the shuffle and stream through the fold, so memory is that of one state, however many events an
    owner has; they do stay in one task, as each depends on all before it.
    """
    schema = log.select(*owner).schema.add("keys", T.ArrayType(T.StringType()))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, kinds = None, [], []
        for batch in batches:
            kinds = [batch.schema.field(o).type for o in owner]
            rows, done = batch.to_pydict(), []
            for key, values in zip(zip(*(rows[o] for o in owner), strict=True), zip(*(rows[e] for e in event), strict=True), strict=True):
                if key != at:
                    if at is not None:
                        done.append((*at, state))
                    at, state = key, []
                step(state, *values)
            if done:
                yield as_batch(done, kinds)
        if at is not None:
            yield as_batch([(*at, state)], kinds)

    def as_batch(rows: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.list_(pa.string())], strict=True)], [*owner, "keys"])

    rows = log.select(*owner, *order, *event).repartition(*owner).sortWithinPartitions(*owner, *order)
    return rows.select(*owner, *event).mapInArrow(walk, schema)


def lru_state(log: DataFrame, owner: list[str], order: list[str], key: str, op: str, cap: int) -> DataFrame:
    """(owner, keys): a cache's keys from least to most recently used after set, get and has events.

    Setting or getting a present key makes it the newest; getting an absent one does nothing, asking never does; past the
    cap the oldest goes.
    """

    def step(state: list[str], k: str, o: str) -> None:
        present = k in state
        if o == "set" or o == "get" and present:
            if present:
                state.remove(k)
            state.append(k)
            del state[:-cap]

    return folded(log, owner, order, [key, op], step)


def fifo_state(log: DataFrame, owner: list[str], order: list[str], key: str, cap: int) -> DataFrame:
    """(owner, keys): a cache that evicts by insertion; a hit keeps its place, an evicted key comes back as the newest."""

    def step(state: list[str], k: str) -> None:
        if k not in state:
            state.append(k)
            del state[:-cap]

    return folded(log, owner, order, [key], step)


def closed_stack(log: DataFrame, owner: list[str], order: list[str], key: str, op: str, cap: int = 10) -> DataFrame:
    """(owner, keys): closed tabs, the last closed at the end; closing again moves to the end, reopening takes the end off."""

    def step(state: list[str], k: str, o: str) -> None:
        if o == "close":
            if k in state:
                state.remove(k)
            state.append(k)
            del state[:-cap]
        elif state:
            state.pop()

    return folded(log, owner, order, [key, op], step)


def cache_entries(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Live entries of put and remove events (op, value): the last event of a key decides."""
    return upsert_latest(log, keys, ["op", "value"], order).filter("op = 'put'").drop("op")


def evict_prefix(entries: DataFrame, key: str, prefix: str) -> DataFrame:
    return entries.filter(~F.col(key).startswith(prefix))


def cache_stats(entries: DataFrame, value: str) -> DataFrame:
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length(F.col(value))), F.lit(0)).alias("bytes"))


def newest_versions(entries: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Only the newest version of each key stays; equal versions all stay."""
    newest = F.max(version).over(Window.partitionBy(*keys))
    return entries.withColumn("newest_", newest).filter(F.col(version) == F.col("newest_")).drop("newest_")


def fresh(entries: DataFrame, seen: str, now: Column, seconds: int) -> DataFrame:
    """Entries seen within so many seconds before ``now``."""
    return entries.filter(F.unix_timestamp(now) - F.unix_timestamp(seen) <= seconds)


def add_absent(present: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Present rows, and of the new ones those whose keys are absent."""
    return present.unionByName(new.join(present.select(*keys).distinct(), keys, "left_anti"))


def batch_report(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))


def moved(items: Column, source: Column, target: Column) -> Column:
    """An array with the item at ``source`` (from 0) taken out and put back at ``target``; out of range: as it was."""
    n = F.size(items)
    rest = F.concat(F.slice(items, 1, source), F.slice(items, source + 2, n))
    put = F.concat(F.slice(rest, 1, target), F.array(F.get(items, source)), F.slice(rest, target + 1, n))
    return F.when((source >= 0) & (source < n) & (target >= 0) & (target < n), put).otherwise(items)


def free_suffix(names: DataFrame, taken: DataFrame) -> DataFrame:
    """(name, free): the first of name, name-1, name-2, … that is not taken.

    taken: (name) rows; null names count for nothing. The taken numbers of a name are counted in order, by ranges, so a name
    may have any number of them: the first that is not its own place tells the gap. Numbers of over nine digits are no gaps.
    """
    number = F.regexp_extract("name", r"-([1-9][0-9]{0,8})$", 1)
    stem = F.substring("name", F.lit(1), F.length("name") - F.length(number) - 1)
    ways = F.array(F.struct(F.col("name").alias("stem"), F.lit(0).alias("k")), F.struct(stem.alias("stem"), F.when(number != "", number).cast("int").alias("k")))
    asked = names.select("name").filter("name is not null").distinct()
    used = taken.filter("name is not null").select(F.inline(ways)).filter("k is not null").join(asked.select(F.col("name").alias("stem")), "stem", "left_semi").distinct()
    placed = sum_before(used, ["stem"], ["k"], F.lit(1).cast("long"), "place")
    gaps = placed.groupBy(F.col("stem").alias("name")).agg(F.coalesce(F.min(F.when(F.col("k") != F.col("place"), F.col("place"))), F.count("*")).alias("gap"))
    both = asked.join(gaps, "name", "left")
    return both.select("name", F.when(F.coalesce("gap", F.lit(0)) == 0, F.col("name")).otherwise(F.concat_ws("-", "name", F.col("gap").cast("string"))).alias("free"))
