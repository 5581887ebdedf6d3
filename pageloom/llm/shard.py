"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table: a start and a stride, both hashed from its
name. Shards take turns, each claiming the first slot of its order that is still free, until the table is full. A row
goes to the shard that holds the slot of its hashed key. Adding or removing one shard moves few rows besides its own.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hex_key, without

#: The lookup table is broadcast; it has one row of two integers a slot, and no more slots than this.
MOST_SLOTS = 1_000_003


def prime_from(n: int) -> int:
    """The smallest prime that is n or more."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def name_hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: int, slots: int) -> list[int]:
    """The shard of each slot. The loop is over slots, whose number is a parameter, never over rows."""
    start = [name_hash(f"start:{s}") % slots for s in range(shards)]
    stride = [name_hash(f"stride:{s}") % (slots - 1) + 1 for s in range(shards)]
    tried, owner, free = [0] * shards, [-1] * slots, slots
    while free:
        for s in range(shards):
            slot = (start[s] + tried[s] * stride[s]) % slots
            while owner[slot] >= 0:
                tried[s] += 1
                slot = (start[s] + tried[s] * stride[s]) % slots
            owner[slot] = s
            tried[s] += 1
            free -= 1
            if not free:
                break
    return owner


def assign_shards(docs: DataFrame, shards: int = 64, slots: int | None = None, key: str = "doc_id", fallback: str | None = "text") -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (ints); all other columns stay, any of those two names is replaced.

    slots: the table's prime size, by default the smallest prime of at least 100 slots a shard, so that shares differ
    by about a hundredth. Rows with the same key share a shard. A null key is replaced by the fallback column's text
    (null: empty), so that rows without a key do not all meet in one shard. An empty table stays empty; text length
    plays no part. No shuffle: the table is broadcast, its size bounded by MOST_SLOTS.
    """
    slots = slots or prime_from(100 * shards)
    if not 1 <= shards < slots <= MOST_SLOTS or prime_from(slots) != slots:
        raise ValueError("slots must be a prime above the number of shards and at most MOST_SLOTS")
    spark = docs.sparkSession
    owners = ",".join(map(str, fill_table(shards, slots)))
    lookup = spark.range(1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))
    there = fallback is not None and fallback.lower() in {c.lower() for c in docs.columns}
    other = F.coalesce(F.col(fallback).cast("string"), F.lit("")) if there else F.lit("")
    text = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null:"), other))
    kept = without(docs.columns, "slot", "shard")
    placed = docs.select(*kept, (hex_key(text) % slots).cast("int").alias("slot"))
    return placed.join(F.broadcast(lookup), "slot").select(*kept, "slot", "shard")
