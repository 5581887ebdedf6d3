"""SimHash near copies of a set similarity: fingerprints in BK-trees propose, the exact Jaccard similarity decides.

Texts of similarity 0.8 differ by about nine of 64 bits, some by twenty. Blocks of equal bits would not tell such pairs
from chance, so shards of fingerprints are keyed by shingles: a key is made of the least shingles of a text in KEY
random orders, and a text has TABLES keys. Two texts of similarity s agree in a key with a chance of s to the power KEY:
at 0.8 none of the keys is shared once in half a billion pairs, while texts with a common passage seldom share one.

A shard's rows are not paired all with all. Its hub is the text of which the most keys are shared at all: of edited
copies the one with the fewest edits. First each text is measured against the hub of most of its shards. What that links
is mostly one component of a shard's rows. Only rows outside the largest component are then looked up in the BK-tree of
the shard's fingerprints, within RADIUS bits; a large shard is cut into chunks with a tree each, and the rows outside
are looked up in all of them. What the tree proposes is measured there and then, in the first of the shards that a pair
shares, and a row gives one link at most to each component. The Jaccard distance is a metric, so two texts whose
distances to one hub differ by more than 1 - t cannot be similar, and are not measured. So no table of pairs is made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, ship, written
from .simhash import BITS, CHUNK, JOIN, SEARCH, BKTree, components, majority

#: Bits by which fingerprints of one shard may differ: four standard deviations above the mean at similarity 0.8.
RADIUS = 22
#: Shingles that a task remembers; this bounds memory only.
REMEMBERED = 8_000_000
#: Shingles of a key, keys of a text, and the two numbers by which each order is made.
KEY, TABLES = 3, 28
ORDERS = np.random.default_rng(17).integers(0, 1 << 64, (2, KEY * TABLES), np.uint64) | np.uint64(1)


def hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Unsigned hashes of a text's shingles, with repeats; fewer words than a shingle are one, a text of no word has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    digest, runs = xxhash.xxh64_intdigest, zip(*(words[i:] for i in range(width)), strict=False)
    return np.array([digest(b" ".join(run), 42) for run in runs] if len(words) > width else [digest(b" ".join(words), 42)], np.uint64)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of a text's distinct shingles, ascending."""
    return np.unique(hashes(text, width))


def keys(grams: np.ndarray) -> np.ndarray:
    """The TABLES keys of a set; those of an empty set are equal for all such."""
    least = np.full(KEY * TABLES, np.iinfo(np.uint64).max)
    for at in range(0, len(grams), 4096):
        least = np.minimum(least, ((grams[at : at + 4096, None] ^ ORDERS[0]) * ORDERS[1]).min(0))
    key = np.arange(TABLES, dtype=np.uint64)
    for of in least.reshape(KEY, TABLES):
        key = (key ^ of) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def prints(docs: DataFrame, width: int) -> DataFrame:
    """(mark, node, size, fingerprint, keys): node is a hash of the whole set, equal for texts of equal shingles.

    Texts of one set may repeat shingles differently, so the fingerprint is that of the distinct shingles.
    """

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for mark, text in zip(batch["mark"], batch["text"], strict=True):
                grams = shingles(text, width)
                node = np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), 42)).view(np.int64)
                out.append((mark, int(node), len(grams), majority(grams), keys(grams)))
            yield pd.DataFrame(out, columns=["mark", "node", "size", "fingerprint", "keys"])

    return docs.mapInPandas(of, "mark string, node long, size long, fingerprint long, keys array<long>")


def one_each(docs: DataFrame, mark: str, repeated: DataFrame) -> DataFrame:
    """``docs`` with one row of each mark; ``repeated`` holds the marks of several rows, and only such rows are shuffled."""
    once = docs.join(repeated, mark, "left_anti")
    return once.unionByName(docs.join(repeated, mark, "left_semi").dropDuplicates([mark]))


def likeness(first: np.ndarray, second: np.ndarray) -> tuple[int, int]:
    """How many shingles two sets have in common, and how many together."""
    common = len(np.intersect1d(first, second, assume_unique=True))
    return common, len(first) + len(second) - common


def measured(pairs: DataFrame, texts: DataFrame, least: float, width: int) -> DataFrame:
    """(a, b, near, linked): the similarity of the texts of each pair, from (node, text) rows, and whether it is enough."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = remembering(width)
        for batch in batches:
            found = []
            for a, b, text_a, text_b in zip(*(batch[c] for c in ("a", "b", "text_a", "text_b")), strict=True):
                common, union = likeness(of(a, text_a), of(b, text_b))
                found.append((a, b, common / max(union, 1), common >= least * union - 1e-9))
            yield pd.DataFrame(found, columns=["a", "b", "near", "linked"])

    met = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return met.mapInPandas(measure, "a long, b long, near double, linked boolean")


def remembering(width: int) -> Callable[[int, str], np.ndarray]:
    """Shingles of a node's text; those of nodes that came lately are remembered, as a group's texts come again and again."""
    known: dict[int, np.ndarray] = {}
    room = 0

    def of(node: int, text: str) -> np.ndarray:
        nonlocal room
        if node not in known:
            if room <= 0:
                known.clear()
                room = REMEMBERED
            known[node] = shingles(text, width)
            room -= len(known[node]) + 100
        return known[node]

    return of


def fits(least: float, size: Column, other: Column) -> Column:
    """Whether sets of these sizes can be similar."""
    return F.least(size, other) >= least * F.greatest(size, other) - 1e-9


@dataclass
class Member:
    """A row of a shard: its node, the label of what it is linked to, and what tells whether another is similar."""

    node: int
    label: int
    size: int
    hub: int
    near: float
    keys: np.ndarray
    grams: np.ndarray

    def may_be_similar(self, other: Member, key: int, least: float) -> bool:
        """Whether the two are still to be measured, here: in the first shard that they share."""
        if self.label == other.label or min(self.size, other.size) < least * max(self.size, other.size) - 1e-9:
            return False
        if self.hub == other.hub and abs(self.near - other.near) > 1 - least + 1e-9:
            return False
        return self.keys[np.argmax(self.keys == other.keys)] == key


def shard_links(rows: DataFrame, least: float, width: int, radius: int) -> DataFrame:
    """Links (a, b) from rows of SHARD_ROW: a shard's tree is built first, of its JOIN rows; then SEARCH rows are looked up.

    A row gives one link to each label that it is similar to.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tree, held, of = None, BKTree(), [], remembering(width)
        for batch in batches:
            links = []
            for key, part, kind, value, text, node, *rest, keys in zip(*(batch[c] for c in SHARD_ROW), strict=True):
                if (key, part) != at:
                    at, tree, held = (key, part), BKTree(), []
                value = int(value) & (1 << BITS) - 1
                row = Member(node, *rest, keys, of(node, text))
                if kind == JOIN:
                    place = tree.add(value)
                    if place == len(held):
                        held.append([])
                    held[place].append(row)
                    continue
                linked = set()
                for place in tree.within(value, radius):
                    for other in held[place]:
                        if other.label not in linked and row.may_be_similar(other, key, least):
                            common, union = likeness(row.grams, other.grams)
                            if common >= least * union - 1e-9:
                                linked.add(other.label)
                                links.append((node, other.node))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*SHARD_ROW).repartition(parts, "key", "part").sortWithinPartitions("key", "part", "kind")
    return dealt.mapInPandas(search, "a long, b long").distinct()


SHARD_ROW = ("key", "part", "kind", "fingerprint", "text", "node", "label", "size", "hub", "near", "keys")


def near_copies(docs: DataFrame, least: float = 0.8, width: int = 5, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(mark, rows, component): each mark, its number of rows, and the least mark of its group; for (mark, text) rows.

    Rows are linked if the Jaccard similarity of their shingles is ``least`` or more; texts without words are equal. A
    group is what links join. Rows of equal marks must have equal texts, as strings. A mark must not be null; an empty
    table gives no rows. Shingles and sets are told apart by 64-bit hashes. A pair is not linked by itself if no key is
    shared, or if it is found in trees alone and the fingerprints differ by more than ``radius`` bits; both are rare at
    0.8 and rarer above (README).
    """
    ship(docs.sparkSession)
    printed = written(prints(docs, width))
    by_node = [F.any_value(c).alias(c) for c in ("size", "fingerprint", "keys")]
    nodes = written(printed.groupBy("node").agg(F.min("mark").alias("mark"), *by_node))
    marks = written(printed.groupBy("mark").agg(F.any_value("node").alias("node"), F.count("*").alias("rows")))
    remove(printed)
    repeated = written(marks.filter("rows > 1").select("mark"))  # of known size, so that a small one is broadcast

    key = Window.partitionBy("key").orderBy("node")
    met = {"last": F.lag("node").over(key), "next": F.lead("node").over(key)}
    shared = nodes.select("node", "size", F.explode("keys").alias("key")).withColumns(met)
    shared = written(shared.filter("last is not null or next is not null").select("key", "node", "size"))
    share = shared.groupBy("node").agg((F.count("*") / TABLES).alias("share"))
    hub = shared.join(share, "node").groupBy("key").agg(F.max(F.struct("share", "node", "size")).alias("hub"))
    met = shared.join(hub, "key").filter((F.col("node") != F.col("hub.node")) & fits(least, F.col("size"), F.col("hub.size")))
    met = met.groupBy(F.col("hub.node").alias("a"), F.col("node").alias("b")).count()
    first = written(met.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b"))

    def texts_of(found: DataFrame) -> DataFrame:
        placed = written(nodes.join(found, "node", "left_semi").select("node", "mark"))
        return written(one_each(docs, "mark", repeated).join(placed, "mark").select("node", "text"))

    texts = texts_of(first.select("a").union(first.select("b")).distinct().toDF("node"))
    tried = written(measured(first, texts, least, width))
    remove(texts)
    links = tried.filter("linked").select("a", "b")
    labels = components(links).withColumnRenamed("label", "linked")
    centres = tried.select(F.col("b").alias("node"), F.col("a").alias("its_hub"), F.col("near").alias("its_near"))
    known = nodes.join(labels, "node", "left").join(centres, "node", "left")
    known = written(known.select("node", "fingerprint", "keys", F.coalesce("linked", "node").alias("label"), F.coalesce("its_hub", "node").alias("hub"), F.coalesce("its_near", F.lit(1.0)).alias("near")))
    labelled = written(shared.join(known.select("node", "label"), "node"))
    remove(shared, first)
    sizes = labelled.groupBy("key", "label").count().groupBy("key")
    most = sizes.agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.sum("count").alias("members"), F.count("*").alias("labels"))
    parts = most.filter("labels > 1").select("key", "most", F.ceil(F.col("members") / chunk).cast("int").alias("parts"))
    open_ = written(labelled.join(parts, "key"))
    remove(labelled)
    texts = texts_of(open_.select("node").distinct())
    own = open_.drop("label").join(known.join(texts, "node"), "node")
    trees = own.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("kind", F.lit(JOIN))
    asked = own.filter("label <> most").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("kind", F.lit(SEARCH))
    more = written(shard_links(trees.unionByName(asked), least, width, radius))
    remove(texts, open_, known)
    links = written(links.unionByName(more))

    labels = components(links)
    groups = written(nodes.select("node", "mark").join(labels, "node", "left").select("node", "mark", F.coalesce("label", "node").alias("label")))
    named = groups.join(groups.groupBy("label").agg(F.min("mark").alias("component")), "label").select("node", "component")
    return marks.join(named, "node").select("mark", "rows", "component")
