"""Trees of any depth and width: depth, preorder and subtree size by pointer doubling, each node visited once.

What hangs from a node with one parent is found in two passes of pointer doubling, each of about log2(depth) rounds: the
first finds tops, depths and subtree sizes (what lies within 2**k levels, plus what lies within as many below that), the
second adds up, along the way from the top, how many places are ahead of each node among its siblings' subtrees. Only nodes with others
below them take part in the rounds; the rest, most of a wide tree, are met once before and once after.

A node with several parents, or one that is also a root, is the top of a tree of its own, and each way into it is a place
in its parent's tree. Such tops are settled in rounds. A place is known by the places of the tops above it, one number a
top, so that places compare in reading order. A top whose ways in are all known gets the first of them; and so does the top
of the first known way of all, as whatever else leads there comes later: this settles cycles as a walk would that visits
every node once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.sums import sum_before
from pageloom.storage import checkpointed, written


def most_rounds(rows: DataFrame) -> int:
    """Rounds of doubling after which only cycles are left."""
    return rows.count().bit_length() + 1


def together(rows: DataFrame, more: DataFrame) -> DataFrame:
    """Both, in no more partitions than a shuffle has: else a loop of unions and broadcast joins doubles them each round."""
    both = rows.unionByName(more)
    return both.coalesce(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def renamed(rows: DataFrame, keys: list[str], **names: str) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(new) for c, new in names.items()])


def measured(inner: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item, top, hops, size) of (keys, item, up, kids) rows, all items of trees that have others below: up is null at a top.

    Sizes are those of whole subtrees, from the numbers of kids. Items that no top reaches (cycles and what hangs from them)
    are left out. Tables of all items are merged, not broadcast: a small file can hold many.
    """
    rows = checkpointed(inner.select(*keys, "item", F.col("up").alias("anc"), F.coalesce("up", "item").alias("top"), F.col("up").isNotNull().cast("long").alias("hops"), F.col("kids").alias("size")))
    for _ in range(most_rounds(rows)):
        below = rows.filter("anc is not null")
        if below.isEmpty():
            break
        sums = below.groupBy(*keys, F.col("anc").alias("item")).agg(F.sum("size").alias("more"))
        above = renamed(rows, keys, item="anc", anc="next", top="its_top", hops="its_hops")
        moved = below.join(above.hint("merge"), [*keys, "anc"]).select(*keys, "item", F.col("next").alias("anc"), F.col("its_top").alias("top"), (F.col("hops") + F.col("its_hops")).alias("hops"), "size")
        still = rows.filter("anc is null").select(*moved.columns)
        rows = checkpointed(together(moved, still).join(sums, [*keys, "item"], "left").withColumn("size", F.col("size") + F.coalesce("more", F.lit(0))).drop("more"))
    return rows.filter("anc is null").select(*keys, "item", "top", "hops", (F.col("size") + 1).alias("size"))


def placed_in_trees(items: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the tops, all others) of (keys, item, up, ord, id, parent) rows of trees, with top, hops, size, and pos, the place in the tree.

    Items that no top reaches are left out.
    """
    kids = checkpointed(items.filter("up is not null").groupBy(*keys, F.col("up").alias("item")).agg(F.count("*").alias("kids")))
    items = checkpointed(items.join(kids, [*keys, "item"], "left"))
    inner = items.filter("kids is not null")
    sizes = checkpointed(measured(inner, keys))
    sized = inner.join(sizes.select(*keys, "item", "size"), [*keys, "item"]).unionByName(items.filter("kids is null").withColumn("size", F.lit(1).cast("long")))
    tops = sized.filter("up is null").drop("kids").withColumns({"top": F.col("item"), "hops": F.lit(0).cast("long"), "pos": F.lit(0).cast("long")})
    below = checkpointed(sum_before(sized.filter("up is not null"), [*keys, "up"], ["ord", "id"], F.col("size"), "ahead"))
    steps = below.filter("kids is not null").select(*keys, "item", "up", (F.col("ahead") + 1).alias("step")).unionByName(inner.filter("up is null").select(*keys, "item", "up", F.lit(0).cast("long").alias("step")))
    above = checkpointed(sizes.drop("size").join(summed_down(steps, keys, "step"), [*keys, "item"]))
    others = below.drop("kids").join(renamed(above, keys, item="up", top="top", hops="hops", sum="sum"), [*keys, "up"])
    return tops, others.withColumns({"hops": F.col("hops") + 1, "pos": F.col("sum") + F.col("ahead") + 1}).select(*tops.columns)


def summed_down(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, item, sum): ``value`` added up from the top to each of (keys, item, up, value) rows of trees."""
    found = checkpointed(rows.select(*keys, "item", F.col("up").alias("at"), F.col(value).alias("sum")))
    for _ in range(most_rounds(found)):
        ended = found.filter("at is null")
        open_ = found.filter("at is not null")
        if open_.isEmpty():
            break
        above = renamed(found, keys, item="at", at="next", sum="more")
        moved = open_.join(above, [*keys, "at"]).select(*keys, "item", F.col("next").alias("at"), (F.col("sum") + F.col("more")).alias("sum"))
        found = written(together(moved, ended))  # a checkpoint would carry the optimiser's constraints, which grow with the rounds
    return found.filter("at is null").select(*keys, "item", "sum")


def way(above: Column, place: Column) -> Column:
    return F.concat(above, F.array(place))


def walk(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, parent, root, depth, n, size) of (keys, id, parent, ord) rows: a walk from the roots that visits a node once.

    A node may have several rows; a row without a parent makes it a root. n counts nodes in the order of the walk, from 0 for
    each key: roots and children by ord, then id; parent is the one that the walk comes from, size the number of nodes of
    the subtree, itself included. Nodes that no root reaches are left out, and so are rows of a null id or key.
    """
    there = reduce(and_, [F.col(c).isNotNull() for c in [*keys, "id"]])
    rows = checkpointed(nodes.filter(there).groupBy(*keys, "id", "parent").agg(F.min("ord").alias("ord")))
    ways = rows.groupBy(*keys, "id").agg(F.count("*").alias("ways"), F.count_if(F.col("parent").isNull()).alias("roots"))
    several = checkpointed(ways.filter("ways > 1 or roots > 0").drop("roots"))
    text = F.col("id").cast("string")
    node, stub = F.concat(F.lit("n"), text), F.concat(F.lit("s"), F.length(text).cast("string"), F.lit(":"), text, F.col("parent").cast("string"))
    up = F.concat(F.lit("n"), F.col("parent").cast("string"))
    singles = rows.join(several, [*keys, "id"], "left_anti").select(*keys, node.alias("item"), up.alias("up"), "ord", "id", "parent")
    stubs = rows.filter("parent is not null").join(several, [*keys, "id"], "left_semi").select(*keys, stub.alias("item"), up.alias("up"), "ord", "id", "parent")
    none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("ord", "parent")]
    tops = several.select(*keys, node.alias("item"), F.lit(None).cast("string").alias("up"), none[0], "id", none[1])
    tops, others = placed_in_trees(singles.unionByName(stubs).unionByName(tops), keys)

    begins = rows.filter("parent is null").select(*keys, "id", "ord").withColumn("all", F.lit(0))
    if several.filter("ways > 1").isEmpty():
        sizes = begins.join(tops.select(*keys, "id", "size", "top"), [*keys, "id"])
        ahead = checkpointed(sum_before(sizes, keys or ["all"], ["ord", "id"], F.col("size"), "ahead").select(*keys, "top", F.col("id").alias("root"), "ahead"))
        return tops.unionByName(others).join(ahead, [*keys, "top"]).select(*keys, "id", "parent", "root", F.col("hops").alias("depth"), (F.col("ahead") + F.col("pos")).alias("n"), "size")
    placed = checkpointed(tops.unionByName(others))
    roots = sum_before(begins, keys or ["all"], ["ord", "id"], F.lit(1).cast("long"), "pos")
    into = placed.filter("item like 's%'").select(*keys, F.col("id").alias("to"), F.col("top").alias("from"), "pos", (F.col("hops") - 1).alias("hops"), "parent")
    first = roots.select(*keys, F.concat(F.lit("n"), F.col("id").cast("string")).alias("top"), F.array("pos").alias("way"), F.lit(0).cast("long").alias("above"), F.lit(None).cast(rows.schema["parent"].dataType).alias("parent"), F.col("id").alias("root"))
    settled = settle(first, into, keys)
    found = placed.filter("item like 'n%'").join(settled.withColumnRenamed("parent", "top_parent"), [*keys, "top"])
    parent = F.when(F.col("up").isNull(), F.col("top_parent")).otherwise(F.col("parent")).alias("parent")
    pos = F.col("pos")
    found = found.select(*keys, "id", parent, "root", (F.col("above") + F.col("hops")).alias("depth"), way(F.col("way"), pos).alias("enters"), F.when(F.col("size") > 1, way(F.col("way"), pos + F.col("size"))).alias("leaves"))
    return numbered(checkpointed(found), keys)


def settle(first: DataFrame, into: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, top, way, above, parent, root) of the tops that the roots reach; ``first`` has the ways of the roots.

    into: (keys, to, from, pos, hops, parent): the places in the tree of top ``from`` that lead to node ``to``.
    """
    name = F.concat(F.lit("n"), F.col("to").cast("string"))
    edges = checkpointed(into.withColumn("top", name))
    if edges.isEmpty():
        return first
    reached = new = checkpointed(first.select(*keys, "top").distinct())
    rounds = 0
    while not new.isEmpty():
        onward = edges.join(new.withColumnRenamed("top", "from"), [*keys, "from"]).select(*keys, "top").distinct()
        new = checkpointed(onward.join(reached, [*keys, "top"], "left_anti"))
        rounds += 1
        reached = joined(reached, new, rounds)
    edges = checkpointed(edges.join(reached.withColumnRenamed("top", "from"), [*keys, "from"]))
    known = checkpointed(first)  # ways whose tops are not settled yet
    waiting = checkpointed(edges.groupBy(*keys, "top").agg(F.count("*").alias("ways")))
    done, rounds = None, 0
    while not known.isEmpty():
        best = F.min(F.struct("way", "above", "parent", "root")).alias("best")
        tops = known.groupBy(*keys, "top").agg(best, F.count_if(F.col("parent").isNotNull()).alias("have")).join(waiting, [*keys, "top"], "left")
        least = known.groupBy(*keys).agg(F.min("way").alias("least"))
        met = tops.join(least, keys) if keys else tops.join(F.broadcast(least))  # one row
        new = checkpointed(met.filter(F.expr("have >= coalesce(ways, 0) or best.way = least")).select(*keys, "top", "best.*"))
        rounds += 1
        done = new if done is None else joined(done, new, rounds)
        ahead = edges.join(new.select(*keys, F.col("top").alias("from"), "way", "above", "root"), [*keys, "from"])
        ahead = ahead.select(*keys, "top", way(F.col("way"), F.col("pos")).alias("way"), (F.col("above") + F.col("hops") + 1).alias("above"), "parent", "root")
        known = checkpointed(together(known, ahead).join(done.select(*keys, "top"), [*keys, "top"], "left_anti"))
    return done


def joined(rows: DataFrame, new: DataFrame, rounds: int) -> DataFrame:
    """Both; written once every eight rounds, else the plan grows with the rounds."""
    both = together(rows, new)
    return both if rounds % 8 else checkpointed(both)


def numbered(found: DataFrame, keys: list[str]) -> DataFrame:
    """n and size, from the places at which the walk enters and leaves each node's subtree; those without others below only enter."""
    told = ["id", "parent", "root", "depth"]
    alone = F.col("leaves").isNull().alias("alone")
    events = found.select(*keys, *told, alone, F.col("enters").alias("at"), F.lit(1).cast("long").alias("one"))
    left = found.filter("leaves is not null").select(*keys, "id", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in told[1:]], alone, F.col("leaves").alias("at"), F.lit(0).cast("long").alias("one"))
    events = events.unionByName(left)
    group = keys or ["all"]
    events = events if keys else events.withColumn("all", F.lit(0))
    counted = checkpointed(sum_before(events, group, ["at", "one", "id"], F.col("one"), "n").drop("at"))
    entered = counted.filter("one = 1").select(*keys, *told, "n", "alone")
    upto = counted.filter("one = 0").select(*keys, "id", F.col("n").alias("upto"))
    size = (F.col("upto") - F.col("n")).alias("size")
    both = entered.filter("not alone").join(upto, [*keys, "id"]).select(*keys, *told, "n", size)
    return both.unionByName(entered.filter("alone").select(*keys, *told, "n", F.lit(1).cast("long").alias("size")))


def paths(walked: DataFrame, keys: list[str], value: str, carried: Sequence[str] = ()) -> DataFrame:
    """(keys, id, path, carried): ``value`` of each node on the way from the root, as an array as long as the way; by pointer doubling.

    walked: (keys, id, parent, value, carried) with one row a node. Only nodes with others below take part in the rounds.
    """
    inner = checkpointed(walked.filter("parent is not null").select(*keys, F.col("parent").alias("id")).distinct())
    rows = walked.join(inner, [*keys, "id"], "left_semi").select(*keys, F.col("id").alias("item"), F.col("parent").alias("up"), F.array(value).alias("value"))
    found = checkpointed(rows.select(*keys, "item", F.col("up").alias("at"), F.col("value").alias("path")))
    for _ in range(most_rounds(found)):
        open_ = found.filter("at is not null")
        if open_.isEmpty():
            break
        above = renamed(found, keys, item="at", at="next", path="more")
        moved = open_.join(above, [*keys, "at"]).select(*keys, "item", F.col("next").alias("at"), F.concat("more", "path").alias("path"))
        found = written(together(moved, found.filter("at is null")))
    ways = renamed(found.filter("at is null"), keys, item="parent", path="_above")
    others = walked.join(ways, [*keys, "parent"]).select(*keys, "id", F.concat("_above", F.array(value)).alias("path"), *carried)
    return walked.filter("parent is null").select(*keys, "id", F.array(value).alias("path"), *carried).unionByName(others)


def nearest_ancestor(nodes: DataFrame, keys: list[str], value: str, most_hops: int | None = None) -> DataFrame:
    """(keys, id, value, hops): each node's own value or that of the nearest ancestor that has one; null beyond ``most_hops``.

    nodes: (keys, id, parent, value), a row a node. A node without a value up to its root, or whose ancestors are a cycle
    without one, has null value and hops. By pointer doubling: about log2(depth) rounds.
    """
    own = F.col(value)
    rows = nodes.select(*keys, "id", F.when(own.isNull(), F.col("parent")).alias("at"), own.alias("found"), F.lit(0).cast("long").alias("hops"))
    rows = checkpointed(rows.withColumn("hops", F.col("at").isNotNull().cast("long")))
    for _ in range(most_rounds(rows)):
        open_ = rows.filter("at is not null")
        if open_.isEmpty():
            break
        above = rows.select(*keys, F.col("id").alias("at"), F.col("at").alias("next"), F.col("found").alias("its"), F.col("hops").alias("more"))
        moved = open_.join(above, [*keys, "at"], "left").select(*keys, "id", F.col("next").alias("at"), F.col("its").alias("found"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"))
        rows = written(together(moved, rows.filter("at is null")))
    near = F.col("found").isNotNull() if most_hops is None else F.col("found").isNotNull() & (F.col("hops") <= most_hops)
    return rows.select(*keys, "id", F.when(near, F.col("found")).alias(value), F.when(near, F.col("hops")).cast("int").alias("hops"))
