"""Object graphs: reachability, exact deduplication, revisions, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators.sums import sum_before
from pageloom.storage import checkpointed


def reachable(edges: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id) that (keys, id) roots reach over (keys, src, dst) edges; a key without any root keeps nothing here.

    Only the new nodes of a round are joined with the edges, which are written once; rounds go on until none is new.
    """
    seen = new = checkpointed(roots.select(*keys, "id").distinct())
    edges = checkpointed(edges.select(*keys, F.col("src").alias("id"), "dst"))
    rounds = 0
    while True:
        found = new.join(edges, [*keys, "id"]).select(*keys, F.col("dst").alias("id")).distinct()
        new = checkpointed(found.join(seen, [*keys, "id"], "left_anti"))
        if new.isEmpty():
            return seen
        rounds += 1
        seen = seen.unionByName(new)
        if rounds % 8 == 0:  # else the plan grows with the rounds
            seen = checkpointed(seen)


def keep_reachable(objects: DataFrame, edges: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """Objects that roots reach; documents where nothing is reached keep all."""
    live = reachable(edges, roots, keys)
    rooted = live.select(*keys).distinct()
    kept = objects.join(live, [*keys, "id"], "left_semi")
    return kept.unionByName(objects.join(rooted, keys, "left_anti"))


def canonical(objects: DataFrame, keys: list[str], body: str, most_bytes: int = 65_536, exempt: tuple[str, ...] = ("Page",)) -> DataFrame:
    """(keys, id, canonical): equal bodies of a kind share the least id; long streams and exempt kinds stay themselves.

    Bodies meet by length and SHA-256, so no body is shuffled; ids are reduced before they meet, so many copies of one
    body are one row, and the way back is a join whose large keys can be split.
    """
    apart = F.coalesce((F.octet_length(body) > most_bytes) | F.col("kind").isin(*exempt) | F.col(body).isNull(), F.lit(False))
    slim = objects.select(*keys, "id", "kind", apart.alias("apart"), F.sha2(F.col(body).cast("binary"), 256).alias("digest"), F.octet_length(body).alias("bytes"))
    same = slim.filter("not apart")
    by = [*keys, "kind", "digest", "bytes"]
    least = same.groupBy(*by).agg(F.min("id").alias("canonical"), F.count("*").alias("copies")).filter("copies > 1").drop("copies")
    mapped = same.join(least, by, "left").select(*keys, "id", F.coalesce("canonical", "id").alias("canonical"))
    return mapped.unionByName(slim.filter("apart").select(*keys, "id", F.col("id").alias("canonical")))


def remap_edges(edges: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Edges from kept objects, with targets replaced by their canonical ones."""
    to = mapping.select(*keys, F.col("id").alias("dst"), F.col("canonical").alias("new_dst"))
    gone = mapping.filter("id <> canonical").select(*keys, F.col("id").alias("src"))
    left = edges.join(gone, [*keys, "src"], "left_anti").join(to, [*keys, "dst"], "left")
    return left.select(*keys, "src", F.coalesce("new_dst", "dst").alias("dst"))


def newest_revision(xref: DataFrame, keys: list[str], revision: str, entry: list[str]) -> DataFrame:
    """The entry of each key's newest revision; of one revision's several entries the last in ``entry`` order."""
    at = F.struct(revision, *entry)
    return xref.groupBy(*keys).agg(F.max(at).alias("row")).select(*keys, "row.*")


def batches(objects: DataFrame, keys: list[str], size: int = 100) -> DataFrame:
    """(keys, id, batch): objects in id order, ``size`` to a batch, batches from 0; a key's objects may be many."""
    before = sum_before(objects.select(*keys, "id"), keys, ["id"], F.lit(1), "before")
    return before.select(*keys, "id", F.floor(F.col("before") / size).alias("batch"))
