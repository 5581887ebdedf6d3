"""Running sums of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.storage import checkpointed


def sum_before(rows: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with, as ``name``, the sum of ``value`` over the rows ahead of each in its group; the order must be total.

    Rows are dealt into ranges of (group, order). The ranges' sums are added up first, of which a group has one a range,
    and rows within their range; so no task holds a group that is larger than a range. A null group is one of its own.
    """
    placed = checkpointed(rows.withColumn("_value", value).repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()))
    by = [*group, "_range"]
    upto = Window.partitionBy(*group).orderBy("_range")
    sums = placed.groupBy(*by).agg(F.sum("_value").alias("_sum")).withColumn("_ahead", F.sum("_sum").over(upto) - F.col("_sum"))
    ahead = sums.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_ahead")
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumn(name, F.sum("_value").over(inside) - F.col("_value"))
    return within.join(ahead, same).withColumn(name, F.col(name) + F.col("_ahead")).select(*rows.columns, name)
