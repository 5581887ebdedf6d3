"""Documents merged as objects: disjoint, dense numbers, rewritten references, one catalogue, one page tree.

A merged document's numbers are counted by its documents, of which a table has a row each: how many objects are ahead of
each. Within a document, objects and references are dealt once, by document, and sorted twice, by sources and by targets:
a reference takes the place of the object that it follows. Documents of more than ``LARGE`` objects are no one task's;
theirs are ranked in ranges and joined by their ids.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.operators.sums import sum_before
from pageloom.storage import checkpointed

#: Objects that a merged document has one of, and those that it has none of. Fixed values.
ONE_EACH, DROPPED = ("Catalog", "Pages"), ("Outlines", "Outline")
#: What an object is to the numbering: any, a page, one that a merged document has one of.
OTHER, PAGE, TREE, CATALOGUE = range(4)
#: Objects of a document that are still one task's.
LARGE = 1 << 20


@dataclass
class Merged:
    """objects: (merged_id, num, kind, doc_id, id), whose body is that of (doc_id, id); edges: (merged_id, src, dst), written once asked for."""

    objects: DataFrame
    links: Callable[[], DataFrame]

    @cached_property
    def edges(self) -> DataFrame:
        return self.links()


def counted(kept: DataFrame, order: DataFrame) -> DataFrame:
    """The rows of ``order`` whose documents have objects, with size, first and last of ONE_EACH, and ahead: others in documents before."""
    known = lambda k, c: F.when(F.col("kind") == k, c)
    # numbers alone are added up by hash: least and greatest structs would sort all objects
    found = [c for k in ONE_EACH for c in (F.max(known(k, F.col("id").isNull())).alias(f"null_{k}"), F.min(known(k, F.col("id"))).alias(f"least_{k}"))]
    docs = kept.groupBy("doc_id").agg(F.count("*").alias("size"), F.count_if(F.col("what") < TREE).alias("many"), *found, F.max(known("Catalog", F.col("id"))).alias("most"))
    there = lambda k, c: F.when(F.col(f"null_{k}").isNotNull(), F.struct(c.alias("id")))
    first = [there(k, F.when(~F.col(f"null_{k}"), F.col(f"least_{k}"))).alias(f"first_{k}") for k in ONE_EACH]
    docs = docs.select("doc_id", "size", "many", *first, there("Catalog", F.col("most")).alias("last_Catalog"))
    rows = order.select("merged_id", "ord", "doc_id").join(docs, "doc_id")
    return checkpointed(sum_before(rows, ["merged_id"], ["ord", "doc_id"], F.col("many"), "ahead"))


def ones_of(kept: DataFrame, places: DataFrame) -> DataFrame:
    """(merged_id, last, Catalog, Pages, cat, tree), a row a merged document: the first of each of ONE_EACH, the last catalogue, their numbers."""
    there = lambda c, *more: F.when(F.col(c).isNotNull(), F.struct("ord", "doc_id", F.col(f"{c}.id").alias("id"), *more))
    first = [F.min(there(f"first_{k}", "ahead")).alias(k) for k in ONE_EACH]
    found = places.groupBy("merged_id").agg(*first, F.max(there("last_Catalog")).alias("last"))
    found = checkpointed(found.select("merged_id", "last", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("at")) for k in ONE_EACH]))))
    at = found.filter("at is not null").select("at.doc_id", F.struct(F.col("at.id").alias("id")).alias("key")).distinct()
    lower = kept.filter(F.col("what") < TREE).join(at, "doc_id").filter(F.struct("id") < F.col("key")).groupBy(F.col("doc_id").alias("_doc"), F.col("key.id").alias("_id")).agg(F.count("*").alias("lower"))
    found = found.join(checkpointed(lower), (F.col("at.doc_id") == F.col("_doc")) & F.col("at.id").eqNullSafe(F.col("_id")), "left")
    here = F.struct("at.ord", "at.doc_id", "at.id")
    by_kind = [F.max(F.when((F.col("kind") == k) & F.col("at").isNotNull(), c)).alias(n) for k in ONE_EACH for n, c in ((k, here), (f"num_{k}", F.col("at.ahead") + F.coalesce("lower", F.lit(0)) + 1))]
    found = found.groupBy("merged_id").agg(F.max("last").alias("last"), *by_kind)
    after = lambda k, other: F.col(f"num_{k}") + F.coalesce(F.col(other) < F.col(k), F.lit(False)).cast("long")
    return checkpointed(found.select("merged_id", "last", *ONE_EACH, after("Catalog", "Pages").alias("cat"), after("Pages", "Catalog").alias("tree")))


def told(places: DataFrame, ones: DataFrame) -> DataFrame:
    """(merged_id, doc_id, ahead, in_Catalog, in_Pages, in_last, cat, tree): what numbers a document's objects; in_: ids of ``ones`` that are its own."""
    ones = ones.withColumnRenamed("merged_id", "_of")
    here = F.struct("ord", "doc_id")
    of = lambda k: F.struct(F.col(f"{k}.ord").alias("ord"), F.col(f"{k}.doc_id").alias("doc_id"))
    own = lambda k: F.col(k).isNotNull() & of(k).eqNullSafe(here)
    # an object without an id is ahead of all others of its document
    before = [F.coalesce((of(k) < here) | (own(k) & F.col(f"{k}.id").isNull()), F.lit(False)) & F.col(k).isNotNull() for k in ONE_EACH]
    ahead = F.col("ahead") + before[0].cast("long") + before[1].cast("long")
    met = places.join(ones, F.col("merged_id").eqNullSafe(F.col("_of")))
    return met.select("merged_id", "doc_id", ahead.alias("ahead"), *[F.when(own(k), F.col(f"{k}.id")).alias(f"in_{k}") for k in (*ONE_EACH, "last")], "cat", "tree")


def number(at: str, rank: str) -> Column:
    """The number of an object that is no one of ONE_EACH, by its id and its rank in its document, from 1."""
    return F.col("ahead") + F.col(rank) + sum(F.coalesce(F.col(f"in_{k}") < F.col(at), F.lit(False)).cast("long") for k in ONE_EACH)


def ranked(kept: DataFrame) -> DataFrame:
    """(doc_id, id, kind, what, rank): each object's place in its document; those of ONE_EACH have no place of their own."""
    upto = Window.partitionBy("doc_id").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    return kept.withColumn("rank", F.count_if(F.col("what") < TREE).over(upto))


def ranked_in_ranges(kept: DataFrame) -> DataFrame:
    """``ranked``, for documents of any size."""
    one = (F.col("what") < TREE).cast("long")
    return sum_before(kept, ["doc_id"], ["id"], one, "rank").withColumn("rank", F.col("rank") + one)


def followed(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, at, what, rank, source, of, of_rank): pages, without a source, and each reference between objects that are there, once.

    Rows are dealt before anything is worked out, and hold four numbers in either sort: a mark is a rank and what has it.
    """
    rows = kept.select("doc_id", F.col("id").alias("at"), "what", F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"))
    rows = rows.unionByName(edges.select("doc_id", F.col("src").alias("at"), F.lit(None).cast("int").alias("what"), "dst")).repartition("doc_id")
    objects_first, edge, begun = F.col("what").asc_nulls_last(), F.col("what").isNull(), Window.unboundedPreceding
    rows = rows.sortWithinPartitions("doc_id", "at", objects_first)
    upto = Window.partitionBy("doc_id").orderBy("at", objects_first).rowsBetween(begun, 0)
    there = F.last(F.when(~edge, F.col("at")), True)
    rows = rows.select("doc_id", "at", "what", "dst", F.last("what", True).over(upto).alias("of"), there.over(upto).alias("there"), F.count_if(F.col("what") < TREE).over(upto).alias("rank"))
    rows = rows.filter(~edge | (F.col("there") == F.col("at")))
    rows = rows.select("doc_id", F.when(edge, F.col("dst")).otherwise(F.col("at")).alias("at"), F.when(edge, F.col("at")).alias("source"), (F.col("rank") * 4 + F.col("of")).alias("mark"))
    at_one = Window.partitionBy("doc_id", "at").orderBy(F.col("source").asc_nulls_first())
    firsts = [F.first(c).over(at_one.rowsBetween(begun, 0)).alias(n) for c, n in (("mark", "its"), ("source", "lost"))]
    rows = rows.select("*", *firsts, F.lag("source").over(at_one).alias("before"))
    edge = F.col("source").isNotNull()
    once = edge & F.col("lost").isNull() & ~F.col("source").eqNullSafe(F.col("before"))
    what, rank = (lambda c: F.col(c).bitwiseAND(3).cast("int")), (lambda c: F.shiftright(c, 2))
    return rows.filter(once | ~edge & (what("mark") == PAGE)).select("doc_id", "at", what("its").alias("what"), rank("its").alias("rank"), "source", F.when(edge, what("mark")).alias("of"), rank("mark").alias("of_rank"))


def followed_by_ids(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """``followed``, for documents of any size: references are joined with their objects."""
    ids = checkpointed(ranked_in_ranges(kept).select("doc_id", F.col("id").alias("at"), "what", "rank"))
    met = edges.select("doc_id", F.col("src").alias("source"), F.col("dst").alias("at")).distinct().join(ids.withColumnsRenamed({"at": "source", "what": "of", "rank": "of_rank"}), ["doc_id", "source"])
    pages = ids.filter(F.col("what") == PAGE).withColumns({"source": F.lit(None).cast(edges.schema["src"].dataType), "of": F.lit(None).cast("int"), "of_rank": F.lit(None).cast("long")})
    return pages.unionByName(met.join(ids, ["doc_id", "at"]).select(*pages.columns))


def renumbered(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """(merged_id, src, dst, page, alike) of rows of ``followed``: a page and its tree, or a reference, which may come again if alike."""
    edge, of, what = F.col("source").isNotNull(), F.col("of"), F.col("what")
    known = ((of == TREE) & what.isin(PAGE, TREE)) | ((of == PAGE) & (what == TREE))  # the page tree is made of the pages
    met = rows.filter(~edge | ~known).join(docs, "doc_id").filter(~edge | (of != CATALOGUE) | (F.col("source") == F.col("in_last")))
    num = lambda w, at, rank: F.when(w == TREE, F.col("tree")).when(w == CATALOGUE, F.col("cat")).otherwise(number(at, rank))
    src = F.when(edge, num(of, "source", "of_rank")).otherwise(F.col("tree"))
    return met.select("merged_id", src.alias("src"), num(what, "at", "rank").alias("dst"), (~edge).alias("page"), (edge & ((of >= TREE) | (what >= TREE))).alias("alike")).filter("src is not null")


def merge_objects(objects: DataFrame, edges: DataFrame, order: DataFrame, large: int = LARGE) -> Merged:
    """Documents joined by (merged_id, ord, doc_id) rows: objects (doc_id, id, kind), references edges (doc_id, src, dst).

    Objects are numbered from 1 in each merged document, by the documents' order and their own ids, without gaps. The
    catalogue has the place of the first and the body of the last document's; page tree nodes become one, in the place of
    the first, above all pages; outlines go. References follow their objects; those to page tree nodes lead to the one that
    is left, those to outlines or to nothing go, and so do those from catalogues but the last. A document may be merged
    more than once; it is numbered anew each time. Numbers are counted by documents, so a merged document is no one task's;
    nor is a document of more than ``large`` objects.
    """
    what = F.when(F.col("kind") == "Page", PAGE).when(F.col("kind") == "Pages", TREE).when(F.col("kind") == "Catalog", CATALOGUE).otherwise(OTHER)
    kept = objects.filter("doc_id is not null").select("doc_id", "id", F.coalesce("kind", F.lit("")).alias("kind"))
    kept = kept.filter(~F.col("kind").isin(*DROPPED)).withColumn("what", what)
    places = counted(kept, order)
    ones = ones_of(kept, places)
    docs = told(places, ones)
    big = places.filter(F.col("size") > large).select("doc_id").distinct()
    big = None if big.isEmpty() else checkpointed(big)

    def parts(small: Callable[..., DataFrame], wide: Callable[..., DataFrame], then: Callable[[DataFrame, DataFrame], DataFrame], *tables: DataFrame) -> DataFrame:
        if big is None:
            return then(small(*tables), docs)
        rest, those = ([t.join(big, "doc_id", how) for t in tables] for how in ("left_anti", "left_semi"))
        return then(small(*rest), docs).unionByName(then(wide(*those), checkpointed(docs.join(big, "doc_id", "left_semi"))))

    def numbered(rows: DataFrame, docs: DataFrame) -> DataFrame:
        return rows.filter(F.col("what") < TREE).join(docs, "doc_id").select("merged_id", number("id", "rank").alias("num"), "kind", "doc_id", "id")

    one = [F.struct(F.lit(k).alias("kind"), F.col(n).alias("num"), F.col(f"{at}.doc_id").alias("doc_id"), F.col(f"{at}.id").alias("id")) for k, n, at in (("Catalog", "cat", "last"), ("Pages", "tree", "Pages"))]
    alone = ones.select("merged_id", F.inline(F.array(*one))).filter("num is not null").select("merged_id", "num", "kind", "doc_id", "id")

    def links() -> DataFrame:
        there = edges.filter("doc_id is not null and src is not null and dst is not null")
        found = checkpointed(parts(followed, followed_by_ids, renumbered, kept, there))
        root = ones.filter("cat is not null and tree is not null").select("merged_id", F.col("cat").alias("src"), F.col("tree").alias("dst"))
        both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
        single = found.filter("not alike").select("merged_id", F.inline(F.when(F.col("page"), both).otherwise(F.array(F.struct("src", "dst")))))
        return found.filter("alike").select("merged_id", "src", "dst").unionByName(root).distinct().unionByName(single)

    return Merged(parts(ranked, ranked_in_ranges, numbered, kept).unionByName(alone), links)
