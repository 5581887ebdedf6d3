"""Page operations asked for in one table: each request goes to its operation, each bad one to a row of errors, in one plan."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pageloom.storage import checkpointed

#: Operations of a request; the order of the pages of each is made by ``page_order``.
OPERATIONS = ("rotate", "remove", "reorder", "extract", "split", "reverse")
INVALID, MISSING = "invalid input", "not found"


class Batch(NamedTuple):
    """pages: (request_id, doc_id, part, position, page, turn); errors: (request_id, doc_id, op, code, message)."""

    pages: DataFrame
    errors: DataFrame


def told(code: str, *message: str | Column) -> Column:
    text = F.concat(*[F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("null")) for m in message])
    return F.struct(F.lit(code).alias("code"), text.alias("message"))


def first_outside(pages: Column, total: Column) -> Column:
    return F.get(F.filter(pages, lambda p: F.coalesce((p < 1) | (p > total), F.lit(True))), F.lit(0))


def first_repeated(pages: Column) -> Column:
    return F.get(F.filter(F.transform(pages, lambda p, i: F.struct(p.alias("p"), (F.array_position(pages, p) <= i).alias("again"))), lambda x: x["again"]), F.lit(0))["p"]


def problem(op: Column, pages: Column, degrees: Column, size: Column, total: Column) -> Column:
    """(code, message) of what is wrong with a request, null if nothing is: the first of its operation's checks that fails."""
    none = F.size(pages) == 0
    out = F.coalesce(F.exists(pages, lambda p: F.coalesce((p < 1) | (p > total), F.lit(True))), F.lit(False))
    range_ = told(INVALID, "Page ", first_outside(pages, total), " out of range (1-", total, ")")
    all_gone = F.size(F.array_distinct(pages)) >= total
    wrong_length = F.size(pages) != total
    twice = F.size(F.array_distinct(pages)) < F.size(pages)
    return (
        F.when(total.isNull(), told(MISSING, "no such document"))
        .when(~F.coalesce(op.isin(*OPERATIONS), F.lit(False)), told(INVALID, "unknown operation ", op))
        .when((op == "rotate") & ~F.coalesce(degrees.isin(90, 180, 270), F.lit(False)), told(INVALID, "Degrees must be 90, 180, or 270"))
        .when(op.isin("remove", "extract") & none, told(INVALID, "No pages specified"))
        .when((op == "reorder") & wrong_length, told(INVALID, "Order length ", F.size(pages), " doesn't match page count ", total))
        .when(op.isin("remove", "extract", "reorder") & out, range_)
        .when((op == "remove") & all_gone, told(INVALID, "Cannot remove all pages from a PDF"))
        .when((op == "reorder") & twice, told(INVALID, "Page ", first_repeated(pages), " appears more than once in order"))
        .when((op == "split") & F.coalesce(size < 1, F.lit(True)), told(INVALID, "Pages per file must be at least 1"))
    )


def page_order(op: Column, pages: Column, total: Column) -> Column:
    """The old pages of what a sound request makes, in order."""
    own = F.sequence(F.lit(1), total)
    return F.when(op == "remove", F.array_except(own, pages)).when(op.isin("reorder", "extract"), pages).when(op == "reverse", F.reverse(own)).otherwise(own)


def run(requests: DataFrame, pages: DataFrame, counts: Observation | None = None) -> Batch:
    """The pages that (request_id, doc_id, op, pages, degrees, size) requests make of (doc_id, page) documents, and their errors.

    rotate turns the pages named (none or null: all; those not there are passed over), remove leaves pages out, reorder
    takes all pages in the order given, extract takes those given, split makes parts of ``size`` pages, reverse turns the
    order round. A request that fails its operation's checks is an error with the reference of its document and what to
    tell; the others are not touched by it. A page counts as often as it is asked for. counts: observes done, failed, total.
    Only requests that go wrong or right are told apart before pages are made; page numbers of one request are one array.
    """
    totals = pages.groupBy("doc_id").agg(F.max("page").cast("int").alias("total"))
    asked = requests.join(totals, "doc_id", "left").withColumn("pages", F.coalesce(F.col("pages").cast("array<int>"), F.array().cast("array<int>")))
    op, listed, total = F.col("op"), F.col("pages"), F.col("total")
    checked = asked.withColumn("problem", problem(op, listed, F.col("degrees"), F.col("size"), total))
    if counts:
        bad = F.col("problem").isNotNull()
        checked = checked.observe(counts, F.count_if(~bad).alias("done"), F.count_if(bad).alias("failed"), F.count(F.lit(1)).alias("total"))
    checked = checkpointed(checked)
    errors = checked.filter("problem is not null").select("request_id", "doc_id", "op", "problem.*")
    sound = checked.filter("problem is null").select("request_id", "doc_id", "op", "pages", "degrees", "size", F.posexplode(page_order(op, listed, total)).alias("at", "page"))
    part = F.when(op == "split", F.floor(F.col("at") / F.col("size")).cast("int")).otherwise(0)
    position = F.when(op == "split", F.col("at") % F.col("size")).otherwise(F.col("at"))
    turned = (op == "rotate") & ((F.size(listed) == 0) | F.array_contains(listed, F.col("page")))
    made = sound.select("request_id", "doc_id", (part + 1).alias("part"), (position + 1).cast("int").alias("position"), "page", F.when(turned, F.col("degrees")).otherwise(0).cast("int").alias("turn"))
    return Batch(made, errors)
