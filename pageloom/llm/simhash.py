"""SimHash near-duplicates with BK-trees over shards of fingerprints.

Equal fingerprints are one node from the start, so copies cost nothing. Two fingerprints within radius r agree in whole
blocks: cut into r + k blocks, at least k of them are equal. Every choice of k blocks is a table; fingerprints that agree
on a table's blocks form a shard. A shard gets a BK-tree (children keyed by their Hamming distance to the parent); a
search follows only edges within the radius of the distance at hand. The number of fingerprints has no bound, so shard
trees are built where the shard's rows meet, not broadcast from the driver. A shard gives back spanning links, never
all its pairs.

A hot shard is cut into chunks, each with its own tree. What chunks and other shards have linked by then is mostly one
component; only a hot shard's members outside its largest component are then looked up in all its chunks, since links
inside that component would tell nothing new. So a dense cluster costs about its size, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, remove, ship, written

BITS = 64
#: Members of a chunk of a shard; larger shards are cut.
CHUNK = 1000


def fingerprint(text: str | None, width: int = 4) -> int:
    """The signed 64-bit SimHash of a text's word shingles; 0 for a text that is null or has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) <= width:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), 42)).view(np.int64))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    ones, n = np.zeros(BITS, np.int64), len(words) - width + 1
    digest, block = xxhash.xxh64_intdigest, []
    for shingle in shingles:
        block.append(digest(shingle, 42))
        if len(block) == 65536:  # a very long text stays small in memory
            ones += _ones(block)
            block = []
    if block:
        ones += _ones(block)
    return _packed(ones * 2 > n)


def majority(hashes: np.ndarray) -> int:
    """The signed fingerprint of unsigned shingle hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += _ones(hashes[at : at + 65536])
    return _packed(ones * 2 > len(hashes))


def _packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0].view(np.int64))


def _ones(hashes: list[int] | np.ndarray) -> np.ndarray:
    seen = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(seen, axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """``docs`` without the text and with ``fingerprint`` as a long."""

    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.withColumn("fingerprint", of(F.col(text))).drop(text)


class BKTree:
    """Integers under Hamming distance; a child is keyed by its distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The place of the value, which is new if no equal one is there."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while distance := (self.values[at] ^ value).bit_count():
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = below
        return at

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of all values within the radius."""
        values, children, todo = self.values, self.children, [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            if kids := children[at]:
                low, high = distance - radius, distance + radius
                todo += [kid for edge, kid in kids.items() if low <= edge <= high]


#: What a row of a shard does: search the tree, then join it; join it only; search it only.
BOTH, JOIN, SEARCH = 0, 1, 2


class Shard:
    """A shard's tree, and which of its nodes are linked so far; its memory is that of the tree."""

    def __init__(self, radius: int) -> None:
        self.radius, self.tree, self.root = radius, BKTree(), []

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def row(self, kind: int, value: int) -> list[tuple[int, int]]:
        """Links of a value to the tree: one to each group of nodes that were not linked before."""
        links, groups = [], []
        if kind != JOIN:
            for other in self.tree.within(value, self.radius):
                group = self.find(other)
                if group not in groups:
                    groups.append(group)
                    if self.tree.values[other] != value:
                        links.append((value, self.tree.values[other]))
        if kind != SEARCH and self.tree.add(value) == len(self.root):
            self.root.append(len(self.root))
            groups.append(len(self.root) - 1)
        for group in groups[1:]:
            self.root[group] = groups[0]
        return links


def layout(nodes: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each table the (shift, width) of its blocks; more nodes take more blocks, so that shards stay small.

    The choice changes the work, never the links found: any layout meets every pair within the radius.
    """
    keep = 1
    while keep < 4 and nodes / 2 ** (BITS * keep / (radius + keep)) > 64:
        keep += 1
    blocks = radius + keep
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    cut = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    return [list(chosen) for chosen in combinations(cut, keep)]


def shard_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of (bk_table, bk_key, bk_chunk, kind, fingerprint) rows; a shard's rows meet in one task, trees first."""
    ship(rows.sparkSession)
    shard = ["bk_table", "bk_key", "bk_chunk"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tree = None, Shard(radius)
        for batch in batches:
            links: list[tuple[int, int]] = []
            for *at, kind, value in zip(*(batch[c].tolist() for c in [*shard, "kind", "fingerprint"]), strict=True):
                if at != key:
                    key, tree = at, Shard(radius)
                links += tree.row(kind, value & (1 << BITS) - 1)
            if links:
                yield _frame(links)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*shard, "kind", "fingerprint").repartition(parts, *shard).sortWithinPartitions(*shard, "kind")
    return dealt.mapInPandas(search, "a long, b long").distinct()


def fingerprint_links(nodes: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints whose components are those of all pairs within the radius.

    nodes: one column ``fingerprint`` of distinct longs, cheap to read again.
    """
    tables = layout(nodes.count(), radius)

    def block(shift: int, width: int):
        return F.shiftrightunsigned("fingerprint", shift).bitwiseAND((1 << width) - 1)

    keys = [F.struct(F.lit(t).alias("bk_table"), F.xxhash64(*[block(*b) for b in chosen]).alias("bk_key")) for t, chosen in enumerate(tables)]
    placed = nodes.select("fingerprint", F.inline(F.array(*keys)))
    large = placed.groupBy("bk_table", "bk_key").count().filter(F.col("count") > chunk)
    large = written(large.select("bk_table", "bk_key", F.ceil(F.col("count") / chunk).cast("int").alias("bk_chunks")))
    chunks = F.coalesce("bk_chunks", F.lit(1))
    mine = F.pmod(F.xxhash64("fingerprint", F.lit("chunk")), chunks).cast("int")
    cut = placed.join(large, ["bk_table", "bk_key"], "left").withColumn("bk_chunk", mine)
    links = shard_links(cut.withColumn("kind", F.lit(BOTH)), radius)
    if not large.limit(1).count():
        return links
    links = written(links)
    labels = components(links).withColumnRenamed("node", "fingerprint")
    hot = placed.join(large, ["bk_table", "bk_key"]).withColumn("bk_chunk", mine).join(labels, "fingerprint", "left")
    hot = written(hot.withColumn("label", F.coalesce("label", "fingerprint")))
    sizes = hot.groupBy("bk_table", "bk_key", "label").count()
    most = sizes.groupBy("bk_table", "bk_key").agg(F.max_by("label", F.struct("count", "label")).alias("most"))
    others = hot.join(written(most), ["bk_table", "bk_key"]).filter("label <> most")
    asked = others.select("bk_table", "bk_key", F.explode(F.sequence(F.lit(0), F.col("bk_chunks") - 1)).alias("bk_chunk"), F.lit(SEARCH).alias("kind"), "fingerprint")
    trees = hot.select("bk_table", "bk_key", "bk_chunk", F.lit(JOIN).alias("kind"), "fingerprint")
    return links.unionByName(shard_links(trees.unionByName(asked), radius)).distinct()


def _frame(links: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({c: np.array([x[i] for x in links], np.uint64).view(np.int64) for i, c in enumerate("ab")})


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b): nodes share a label if links join them.

    Each round takes the least label among the neighbours and then that label's own label, so paths shrink by more than
    half; only the count of changes comes back to the driver. Tables are written each round: a lost executor costs no
    more than its tasks, and joins see true sizes and can split a hub's rows.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = written(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        of = met.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = written(met.join(of, "label").select("node", "old", F.least("label", "further").alias("label")))
        changed = new.filter("old <> label").limit(1).count()
        remove(labels, met)
        if not changed:
            remove(both)
            return new.select("node", "label")
        labels = new.select("node", "label")
        labels.written_to = new.written_to


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, fingerprint (16 hex digits) and component_id, the least key reachable over near links.

    A null or empty text, or one without words, has fingerprint zero, linked like any other; shorter texts than a
    shingle are one shingle. Repeated rows give repeated results. A null key takes part and stays null; a component of
    null keys alone has a null id. An empty table stays empty. Extra columns are not read.
    """
    prints = checkpoint(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), width=width))
    nodes = written(prints.groupBy("fingerprint").agg(F.min("key").alias("least")))
    links = written(fingerprint_links(nodes.select("fingerprint"), radius))
    labels = components(links)
    linked = labels.join(nodes.withColumnRenamed("fingerprint", "node"), "node")
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    moved = linked.join(least, "label").select(F.col("node").alias("fingerprint"), "component_id")
    whole = nodes.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id"))
    out = prints.join(written(whole), "fingerprint")
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
