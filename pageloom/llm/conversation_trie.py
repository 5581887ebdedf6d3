"""The trie of conversation prefixes, from the LCP array of the sorted conversations.

Turns are told apart by the MD5 of role and text. Conversations are cut into blocks of WIDTH turns; blocks are ranked by
order, then blocks of ranks, until one block a conversation is left: no row holds more than WIDTH items, however long a
conversation is. Equal conversations become one sequence, and the sequences are numbered in order. lcp(i) is the number of
turns that sequence i shares with the one before it, found from the top level down.

The nodes of the trie at which sequences part are those of the Cartesian tree over the LCP array: the node of element k
spans from its nearest smaller value on the left to that on the right, and elements of equal value in one span are one node.
Nearest smaller values come in parallel: the array is cut into blocks, a task takes a block with a stack, and what it
cannot answer goes to the nearest block whose minimum is smaller (the minima, MOST_BLOCKS at most, are known to all tasks),
where the chain of that block's suffix or prefix minima has the answer: an equi-join on block and value. A node of the
Cartesian tree stands for a run of depths, down from its parent's; these are unfolded, and what is summed over a subtree is
a difference of running sums over the nodes in preorder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.sums import sum_before

from .common import remove, ship, written

#: Items of a block of a conversation.
WIDTH = 64
#: Blocks of the LCP array: their number is bounded, and none but the last is shorter than LEAST_BLOCK.
MOST_BLOCKS, LEAST_BLOCK = 4096, 1024
#: Depths that one row unfolds at once.
RUN = 4096


#: Of the nearest smaller value: its place, itself, and how many conversations and leaves are before its place.
LEFT, RIGHT = ("left", "lv", "convs_left", "leaves_left"), ("right", "rv", "convs_right", "leaves_right")
FOUND = ["kind", "block", "idx", "v", "size", "n", "least", "next", "first", *LEFT, "left_block", "left_v", *RIGHT, "right_block", "right_v", "low"]
FOUND_TYPE = ", ".join(f"{c} long" for c in FOUND)
#: Kinds of rows: an element of the LCP array, and the chains that answer what other blocks ask from the right and the left.
ELEMENT, FROM_RIGHT, FROM_LEFT = 0, 1, 2
UNKNOWN, LAST = -(1 << 60), (1 << 63) - 1


class Trie(NamedTuple):
    """nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sequence (of the conversations
    that end there, else null); ends: (sequence, conv_id) of every conversation."""

    nodes: DataFrame
    ends: DataFrame


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, chars): pos counts from 0 by turn, null first, then by the turn's MD5; of rows with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("at"), turn.alias("turn"), F.char_length(text).cast("long").alias("chars"))
    return sum_before(rows, ["conv_id"], ["at", "turn"], F.lit(1).cast("long"), "pos").select("conv_id", "pos", "turn", "chars")


def rebranched(turns: DataFrame, block: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns of conversations that begin like the first of their block, and all (conv_id, size): those without turns too.

    Conversation c takes the first h turns of conversation c - c % block, then its own after its first h; h is the
    unsigned crc32 of c in decimals, modulo ``heads``.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"head": head, "leader": F.col("conv_id") - F.col("conv_id") % block})
    first = turns.filter((F.col("conv_id") % block == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "leader")
    led = first.groupBy("leader").agg(F.count("*").alias("led"))
    convs = convs.join(led, "leader", "left").withColumn("led", F.least("head", F.coalesce("led", F.lit(0))))
    convs = written(convs.withColumn("size", F.col("led") + F.greatest(F.col("own") - F.col("head"), F.lit(0))))
    taken = convs.join(first, "leader").filter("pos < head").select("conv_id", "pos", "turn", "chars")
    rest = turns.join(convs.select("conv_id", "head", "led"), "conv_id").filter("pos >= head")
    rest = rest.select("conv_id", (F.col("pos") - F.col("head") + F.col("led")).alias("pos"), "turn", "chars")
    return taken.unionByName(rest), convs.select("conv_id", "size")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns as they are, and (conv_id, size)."""
    return turns, turns.groupBy("conv_id").agg(F.count("*").alias("size"))


def gathered(items: DataFrame, item: str, width: int) -> DataFrame:
    """(conv_id, block, items) of (conv_id, pos, item) rows."""
    met = items.groupBy("conv_id", F.floor(F.col("pos") / width).alias("block"))
    return met.agg(F.array_sort(F.collect_list(F.struct("pos", F.col(item).alias("item")))).getField("item").alias("items"))


def levels_of(turns: DataFrame, convs: DataFrame, width: int) -> list[DataFrame]:
    """Blocks of turns, blocks of their ranks and so on; in the last, each conversation is one block."""
    found = gathered(turns, "turn", width)
    none = convs.filter("size = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.array().cast("array<binary>").alias("items"))
    levels = [written(found.unionByName(none))]
    while levels[-1].filter("block > 0").limit(1).count():
        blocks = levels[-1]
        distinct = blocks.select("items").distinct().withColumn("all", F.lit(0))
        ranks = written(sum_before(distinct, ["all"], ["items"], F.lit(1).cast("long"), "rank").select("items", "rank"))
        placed = blocks.join(ranks, "items").select("conv_id", F.col("block").alias("pos"), "rank")
        levels.append(written(gathered(placed, "rank", width)))
        remove(ranks)
    return levels


def shared_items(items: Column, last: Column) -> Column:
    """How many items two arrays have in common from the start; null counts as empty."""
    same = F.transform(items, lambda x, i: F.coalesce(x == F.get(last, i), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    return F.coalesce(F.when(differs > 0, differs - 1).otherwise(F.size(items)), F.lit(0)).cast("long")


def sequences(levels: list[DataFrame], convs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(idx, least, n, size, lcp, covers) of the distinct sequences in order, and (sequence, conv_id).

    least: the least conversation; n: conversations; covers: 1 if the sequence before is a prefix of this one. lcp is -1
    for the first.
    """
    top = levels[-1].join(convs, "conv_id").select("conv_id", "items", "size")
    same = top.groupBy("items").agg(F.min("conv_id").alias("least"), F.count("*").alias("n"), F.any_value("size").alias("size"))
    placed = written(sum_before(same.withColumn("all", F.lit(0)), ["all"], ["items"], F.lit(1).cast("long"), "idx").drop("all"))
    ends = written(levels[-1].join(placed.select("items", F.col("idx").alias("sequence")), "items").select("sequence", "conv_id"))
    before = placed.select((F.col("idx") + 1).alias("idx"), F.col("least").alias("last"), F.col("size").alias("last_size"), F.col("items").alias("last_items"))
    pairs = placed.join(before, "idx").withColumn("lcp", shared_items(F.col("items"), F.col("last_items"))).drop("items", "last_items")
    for blocks in reversed(levels[:-1]):
        of = blocks.select(F.col("conv_id").alias("least"), F.col("block").alias("lcp"), "items")
        of_last = blocks.select(F.col("conv_id").alias("last"), F.col("block").alias("lcp"), F.col("items").alias("last_items"))
        met = pairs.join(of, ["least", "lcp"], "left").join(of_last, ["last", "lcp"], "left")
        pairs = met.withColumn("lcp", F.col("lcp") * width + shared_items(F.col("items"), F.col("last_items"))).drop("items", "last_items")
    pairs = pairs.select("idx", "least", "n", "size", "lcp", (F.col("lcp") == F.col("last_size")).cast("long").alias("covers"))
    first = placed.filter("idx = 0").select("idx", "least", "n", "size", F.lit(-1).cast("long").alias("lcp"), F.lit(0).cast("long").alias("covers"))
    return written(pairs.unionByName(first)), ends


class Range:
    """Minima of ranges of an array, by minima over powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.tables = [values]
        while (half := 1 << (len(self.tables) - 1)) * 2 <= len(values):
            self.tables.append(np.minimum(self.tables[-1][:-half], self.tables[-1][half:]))

    def least(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of [start, end) each; the largest long for an empty range."""
        out = np.full(len(start), LAST)
        size = end - start
        for k, table in enumerate(self.tables):
            at = np.flatnonzero((size >= 1 << k) & (size < 2 << k))
            out[at] = np.minimum(table[start[at]], table[end[at] - (1 << k)])
        return out


def smaller_before(values: list[int]) -> tuple[list[int], list[bool], list[int]]:
    """For each value the place of the nearest smaller one before it (-1 for none), whether an equal one comes between, and
    the places that are left on the stack: those that no later value is smaller than or equal to."""
    stack: list[int] = []
    places, equal = [], []
    for i, v in enumerate(values):
        last = None
        while stack and values[stack[-1]] >= v:
            last = values[stack.pop()]
        places.append(stack[-1] if stack else -1)
        equal.append(last == v)
        stack.append(i)
    return places, equal, stack


def nearest_smaller(seqs: DataFrame, most_blocks: int, least_block: int) -> DataFrame:
    """FOUND rows of the LCP array: what each block's task knows of its elements, and its chains. No rows for no sequences."""
    ship(seqs.sparkSession)
    total = seqs.count()
    length = max(least_block, -(-total // most_blocks))
    placed = seqs.withColumn("block", F.floor(F.col("idx") / length))
    of = {"low": F.min("lcp"), "last": F.max_by("lcp", "idx"), "first": F.min_by("lcp", "idx"), "n": F.sum("n"), "covers": F.sum("covers"), "least": F.min("least")}
    rows = placed.groupBy("block").agg(*[c.alias(k) for k, c in of.items()]).orderBy("block").collect()  # most_blocks at most
    if not rows:
        return seqs.sparkSession.createDataFrame([], FOUND_TYPE)
    table = {k: np.array([r[k] for r in rows], np.int64) for k in of}

    def of_block(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("idx")
        b, m = int(batch["block"].iloc[0]), len(batch)
        idx, lcp, least, n, covers, size = (batch[c].to_numpy(np.int64) for c in ("idx", "lcp", "least", "n", "covers", "size"))
        convs = table["n"][:b].sum() + np.cumsum(n) - n  # of the sequences before each, as leaves
        leaves = idx - (table["covers"][:b].sum() + np.cumsum(covers))
        behind = int(table["first"][b + 1]) if b + 1 < len(rows) else -1
        values = lcp.tolist()
        left, equal, chain_left = map(np.array, smaller_before(values))
        right, _, chain_right = (m - 1 - np.array(x) for x in smaller_before(values[::-1]))
        right = right[::-1]  # m where there is none
        ranges = Range(least)
        out = {c: np.full(m, UNKNOWN) for c in FOUND}
        out |= {"kind": np.full(m, ELEMENT), "idx": idx, "v": lcp, "size": size, "n": n, "least": least, "next": np.append(lcp[1:], behind), "first": (~equal).astype(np.int64)}
        low = ranges.least(np.maximum(left, 0), right)
        here, there = left >= 0, right < m
        for names, known, places in ((LEFT, here, left), (RIGHT, there, right)):
            for c, of in zip(names, (idx, lcp, convs, leaves), strict=True):
                out[c][known] = of[places[known]]
        for v in np.unique(lcp[~here & (lcp > -1)]):
            at = np.flatnonzero(~here & (lcp == v))
            target = int(np.flatnonzero(table["low"][:b] < v)[-1])
            out["left_block"][at], out["left_v"][at] = target, min(v, table["last"][target] + 1)
            low[at] = np.minimum(low[at], table["least"][target + 1 : b].min(initial=LAST))
        for v in np.unique(lcp[~there]):
            at = np.flatnonzero(~there & (lcp == v))
            later = np.flatnonzero(table["low"][b + 1 :] < v)
            target = b + 1 + int(later[0]) if len(later) else len(rows)
            low[at] = np.minimum(low[at], table["least"][b + 1 : target].min(initial=LAST))
            if len(later):
                out["right_block"][at], out["right_v"][at] = target, min(v, table["first"][target] + 1)
            else:
                for c, x in zip(RIGHT, (total, -1, table["n"].sum(), total - table["covers"].sum()), strict=True):
                    out[c][at] = x
        out["low"] = low
        parts = [out]
        for kind, chain, names in ((FROM_RIGHT, chain_left, LEFT), (FROM_LEFT, chain_right, RIGHT)):
            most = np.append(lcp[chain[1:]], lcp[chain[-1]] + 1)  # each place answers for values over its own, up to this
            places = np.repeat(chain, most - lcp[chain])
            nth = np.arange(len(places)) - np.repeat(np.cumsum(most - lcp[chain]) - (most - lcp[chain]), most - lcp[chain])
            starts, ends = (places, np.full(len(places), m)) if kind == FROM_RIGHT else (np.zeros(len(places), np.int64), places)
            found = {c: np.full(len(places), UNKNOWN) for c in FOUND}
            found |= {"kind": np.full(len(places), kind), "v": lcp[places] + 1 + nth, "low": ranges.least(starts, ends)}
            parts.append(found | {c: of[places] for c, of in zip(names, (idx, lcp, convs, leaves), strict=True)})
        return pd.DataFrame({c: np.concatenate([x[c] for x in parts]) for c in FOUND}).assign(block=b)[FOUND]

    return placed.groupBy("block").applyInPandas(of_block, FOUND_TYPE)


def spans(found: DataFrame) -> DataFrame:
    """The elements of the LCP array with their nearest smaller values, wherever those are, and the least conversation between."""
    elements = found.filter(F.col("kind") == ELEMENT)
    for kind, names, block, v in ((FROM_RIGHT, LEFT, "left_block", "left_v"), (FROM_LEFT, RIGHT, "right_block", "right_v")):
        chain = found.filter(F.col("kind") == kind).select(F.col("block").alias(block), F.col("v").alias(v), *[F.col(c).alias(f"of_{c}") for c in (*names, "low")])
        elements = elements.join(chain, [block, v], "left")
        known = F.col(block) == UNKNOWN
        elements = elements.withColumns({c: F.when(known, F.col(c)).otherwise(F.col(f"of_{c}")) for c in names} | {"low": F.least("low", "of_low")})
        elements = elements.drop(*[f"of_{c}" for c in (*names, "low")])
    return elements.select("idx", "v", "size", "n", "least", "next", "first", *LEFT, *RIGHT, "low")


def runs(elements: DataFrame) -> DataFrame:
    """Runs of depths [start, stop] of one span [l, end) of sequences, each with the run above: (up, start - 1), null at the root.

    The span's n_convs, n_leaves and least conversation ``low`` come along, as do size and least of sequence l.
    """
    parted = elements.filter("idx > 0 and first = 1").dropDuplicates(["left", "v"])
    parted = parted.select(F.col("left").alias("l"), F.col("right").alias("end"), F.greatest("lv", "rv").alias("above"), F.col("v").alias("stop"), "lv", "rv", (F.col("convs_right") - F.col("convs_left")).alias("n_convs"), (F.col("leaves_right") - F.col("leaves_left")).alias("n_leaves"), "low")
    single = elements.filter(F.greatest("v", "next") < F.col("size"))
    single = single.select(F.col("idx").alias("l"), (F.col("idx") + 1).alias("end"), F.greatest("v", "next").alias("above"), F.col("size").alias("stop"), F.col("v").alias("lv"), F.col("next").alias("rv"), F.col("n").alias("n_convs"), F.lit(1).cast("long").alias("n_leaves"), F.col("least").alias("low"))
    of = elements.select(F.col("idx").alias("l"), F.col("left").alias("before"), "size", "least")
    up = F.when(F.col("above") < 0, None).when(F.col("lv") >= F.col("rv"), F.col("before")).otherwise(F.col("l"))
    return parted.unionByName(single).join(of, "l").select("l", "end", (F.col("above") + 1).alias("start"), "stop", "rv", "n_convs", "n_leaves", "low", "size", "least", up.alias("up"))


def prefix_trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH, most_blocks: int = MOST_BLOCKS, least_block: int = LEAST_BLOCK) -> Trie:
    """The trie of all prefixes of conversations: of (conv_id, pos, turn, chars) and (conv_id, size) rows, as ``rebranched`` gives.

    A node of depth d is a distinct sequence of first d turns; the root has depth 0. conv_id: the least conversation that
    begins so; n_convs: how many do; n_children: nodes one turn deeper; n_leaves: childless nodes in the node's subtree,
    itself included; saved_tokens: the sum over the subtree of (n_convs - 1) times the chars of a node's last turn. No
    conversation gives no node; conversations without turns end at the root. Turns are told apart by 128-bit hashes.
    """
    turns = written(turns)
    levels = levels_of(turns, convs, width)
    seqs, ends = sequences(levels, convs, width)
    remove(*levels)
    elements = written(spans(written(nearest_smaller(seqs, most_blocks, least_block))))
    found = written(runs(elements))
    children = found.filter("up is not null").groupBy(F.col("up").alias("l"), (F.col("start") - 1).alias("stop")).agg(F.count("*").alias("children"))
    above = found.select(F.col("l").alias("up"), (F.col("stop") + 1).alias("start"), F.col("low").alias("parent"))
    found = found.join(children, ["l", "stop"], "left").join(above, ["up", "start"], "left")
    pieces = found.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("stop") - F.col("start")) / RUN))))
    low = F.col("start") + F.col("piece") * RUN
    nodes = pieces.withColumn("depth", F.explode(F.sequence(low, F.least(F.col("stop"), low + RUN - 1))))
    chars = turns.select(F.col("conv_id").alias("least"), (F.col("pos") + 1).alias("depth"), "chars")
    nodes = nodes.join(chars, ["least", "depth"], "left").withColumn("own", (F.col("n_convs") - 1) * F.coalesce("chars", F.lit(0)))
    summed = written(sum_before(nodes.withColumn("all", F.lit(0)), ["all"], ["l", "depth"], F.col("own"), "before"))
    total = summed.agg(F.sum("own")).first()[0] or 0
    begins = elements.select(F.col("idx").alias("l"), (F.col("v") + 1).alias("depth"))
    begins = summed.select("l", "depth", "before").join(begins, ["l", "depth"]).select(F.col("l").alias("end"), F.col("before").alias("upto"))
    saved = F.coalesce("upto", F.lit(total)) - F.col("before")
    inner, last = F.col("depth") < F.col("stop"), F.col("depth") == F.col("size")
    out = summed.join(begins, "end", "left").select(
        F.col("low").alias("conv_id"), "depth", F.when(F.col("depth") > F.col("start"), F.col("low")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        F.when(inner, 1).otherwise(F.coalesce("children", F.lit(0))).cast("long").alias("n_children"), "n_leaves", saved.cast("long").alias("saved_tokens"), F.when(last, F.col("l")).alias("sequence"))
    return Trie(out, ends)


def ids_digest(ends: DataFrame) -> DataFrame:
    """(sequence, ends_sha256): the SHA-256 of each sequence's conversation ids in ascending order, joined by commas.

    Ids are dealt into ranges, of which a sequence of many conversations has many; each range makes one text, and the texts
    of a sequence are hashed in turn: SHA-256 goes from start to end, so one task passes over a sequence's texts, holding one.
    """
    ship(ends.sparkSession)
    placed = ends.repartitionByRange("sequence", "conv_id").withColumn("part", F.spark_partition_id())
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    texts = placed.groupBy("sequence", "part").agg(F.min("conv_id").alias("first"), ids.alias("ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            done = []
            for sequence, ids in zip(batch["sequence"], batch["ids"], strict=True):
                if sequence != at:
                    if state:
                        done.append((at, state.hexdigest()))
                    at, state = sequence, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["sequence", "ends_sha256"])
        if state:
            yield pd.DataFrame([(at, state.hexdigest())], columns=["sequence", "ends_sha256"])

    return texts.repartition("sequence").sortWithinPartitions("sequence", "first").mapInPandas(hashed, "sequence long, ends_sha256 string")
