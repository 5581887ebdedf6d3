"""Nested objects as rows: the canonical text of what is plain, a digest of what is nested, equal objects found.

A digest is made from the inside out, one level of nesting a round. What is inside a dictionary counts by name, whatever
the order, and what is inside an array by place. The digests inside are added up, so that a dictionary or array of any size
is summed in parts before anything is shuffled and is never gathered.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.functions.scalar import canonical_real
from pageloom.operators.trees import joined
from pageloom.storage import checkpointed

#: Kinds that hold others.
NESTED = ("dict", "array")
#: Characters that a name spells as #XX, besides those that are not printable ASCII. Fixed values.
SPELLED = "()<>[]{}/%#"
#: A name of characters that are not spelled.
UNSPELLED = r"""^["$&'*-.0-;=?-Z\\^-z|~]*\z"""
#: What is known of a dictionary or array: two sums of digests, values right inside, values in these and all below, and how many are still to come.
SUMS = {"one": "decimal(38,0)", "two": "decimal(38,0)", "inside": "long", "nodes": "long", "waits": "long"}


def bytes_of(text: Column) -> Column:
    """The UTF-8 bytes of a text as two hex digits each."""
    return F.regexp_extract_all(F.hex(text.cast("string").cast("binary")), F.lit("(..)"), F.lit(1))


def name_text(name: Column) -> Column:
    """A name with its slash; bytes that a name cannot hold are spelled as #XX."""
    odd = F.array(*[F.lit(f"{ord(c):02X}") for c in SPELLED])

    def spelled(pair: Column) -> Column:
        plain = (pair >= "22") & (pair <= "7E") & ~F.array_contains(odd, pair)
        return F.when(plain, F.decode(F.unhex(pair), "UTF-8")).otherwise(F.concat(F.lit("#"), pair))

    text = F.when(name.rlike(UNSPELLED), name).otherwise(F.array_join(F.transform(bytes_of(name), spelled), ""))
    return F.concat(F.lit("/"), text)


def string_text(text: Column) -> Column:
    """In parentheses if it is printable ASCII without parentheses and backslashes, else in hex digits."""
    plain = text.rlike(r"^[\x20-\x27\x2A-\x5B\x5D-\x7E]*\z")
    return F.when(plain, F.concat(F.lit("("), text, F.lit(")"))).otherwise(F.concat(F.lit("<"), F.hex(text.cast("binary")), F.lit(">")))


def plain_text(kind: Column, value: Column) -> Column:
    """The canonical text of a value that holds no others; null for a nested one and for a value that its kind cannot have."""
    return (
        F.when((kind == "null") | (value.isNull() & ~kind.isin(*NESTED)), F.lit("null"))
        .when(kind == "bool", F.lower(value))
        .when(kind == "int", value.try_cast("bigint").cast("string"))
        .when(kind == "real", canonical_real(value.try_cast("double")))
        .when(kind == "name", name_text(value))
        .when(kind == "string", string_text(value))
        .when(kind == "ref", F.concat(F.regexp_replace(F.trim(value), r"\s+", " "), F.lit(" R")))
        .when(kind == "data", F.concat(F.lit("stream "), F.sha2(value.cast("binary"), 256)))
    )


def half(digits: str, at: int) -> Column:
    """15 of a column's hex digits as a number that can be added up."""
    return F.conv(F.substring(digits, at, 15), 16, 10).cast("decimal(38,0)")


def added(rows: DataFrame, keys: list[str], waits: Column) -> DataFrame:
    """(keys, id, SUMS) of what (keys, parent, label, digest, nodes) rows are in; those without a digest are counted alone."""
    under = F.sha2(F.concat_ws("=", "label", "digest"), 256)
    hashed = rows.withColumn("hash", F.when(F.col("digest").isNotNull(), under))
    sums = hashed.withColumns({"one": half("hash", 1), "two": half("hash", 16)}).groupBy(*keys, F.col("parent").alias("id"))
    return sums.agg(F.sum("one").alias("one"), F.sum("two").alias("two"), F.count("*").alias("inside"), F.sum("nodes").alias("nodes"), waits.alias("waits"))


def digests(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, digest, nodes) of the objects in (keys, id, parent, name, pos, kind, value) rows: those without a parent.

    An object's rows have ids of their own within keys; parent is the id of the dictionary or array that a value is in,
    under ``name`` or at ``pos``. Two objects have one digest if their canonical texts are equal but for the order of names:
    numbers that are equal to six decimals are, an integer and a real of one text too. nodes counts an object's values, itself included. A
    name that comes twice in a dictionary counts twice. Rows that no object reaches, such as circles and what is in a value
    that is no dictionary or array, give nothing, and so do rows of a null id or key.

    Plain values are added to what holds them at once; only dictionaries and arrays go through the rounds, each until all
    that is inside it is known.
    """
    there = reduce(and_, [F.col(c).isNotNull() for c in [*keys, "id"]])
    label = F.coalesce(name_text(F.col("name")), F.col("pos").cast("string"), F.lit(""))
    nested = F.coalesce(F.col("kind").isin(*NESTED), F.lit(False))
    own = F.when(~F.col("nested"), F.sha2(F.coalesce(plain_text(F.col("kind"), F.col("value")), F.lit("null")), 256))
    rows = nodes.filter(there).select(*keys, "id", "parent", label.alias("label"), "kind", "value", nested.alias("nested"))
    rows = rows.select(*keys, "id", "parent", "label", "kind", "nested", own.alias("own"))
    zero = F.lit(0).cast("long")
    inside = added(rows.filter("parent is not null").withColumns({"digest": F.col("own"), "nodes": F.when(F.col("nested"), zero).otherwise(1)}), keys, F.count_if("nested"))
    tops = rows.filter("nested or parent is null").join(inside.hint("merge"), [*keys, "id"], "left")
    told = [F.when(F.col("nested"), F.coalesce(c, F.lit(0))).otherwise(0).cast(t).alias(c) for c, t in SUMS.items()]
    waiting = checkpointed(tops.select(*keys, "id", "parent", "label", "kind", "own", *told))
    found, rounds = None, 0
    while True:
        ready = waiting.filter("waits = 0")
        inner = F.concat_ws(":", "kind", *[F.col(c).cast("string") for c in ("inside", "one", "two")])
        ready = ready.withColumns({"digest": F.coalesce("own", F.sha2(inner, 256)), "nodes": F.col("nodes") + 1})
        whole, rounds = ready.filter("parent is null").select(*keys, "id", "digest", "nodes"), rounds + 1
        found = whole if found is None else joined(found, whole, rounds)
        ready = ready.filter("parent is not null")
        if ready.isEmpty():
            return found
        more = added(ready, keys, F.count("*")).withColumnsRenamed({c: f"_{c}" for c in SUMS})
        rest = waiting.filter("waits > 0").join(more.hint("merge"), [*keys, "id"], "left")
        # what is inside was counted at first
        after = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("one", "two", "nodes")} | {"waits": F.col("waits") - F.coalesce("_waits", F.lit(0))}
        waiting = checkpointed(rest.select(*keys, "id", "parent", "label", "kind", "own", *[after.get(c, F.col(c)).cast(t).alias(c) for c, t in SUMS.items()]))


def equal_objects(nodes: DataFrame, keys: list[str], within: list[str] | None = None) -> DataFrame:
    """(keys, id, canonical): the least id of the objects of equal structure, within the keys of ``within`` (all, if None)."""
    by = keys if within is None else within
    found = checkpointed(digests(nodes, keys))
    least = found.groupBy(*by, "digest").agg(F.min("id").alias("canonical"))
    return found.join(least.hint("merge"), [*by, "digest"]).select(*keys, "id", "canonical")
