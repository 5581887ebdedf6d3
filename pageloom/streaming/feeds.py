"""Live forms of the state operators, and a folder feed, in Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.operators.state import upsert_latest


def latest_values(events: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """A running table of the last value of each key: state is one row a key, late events never win over newer ones."""
    return events.groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))


def merge_batches(events: DataFrame, folder: str, keys: list[str], values: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch's last write of a key is added to the table in ``folder``, whatever batch the key came in before.

    A batch is reduced by itself and written under its number, so it costs its own size, and one that is run again after
    a failure replaces what it wrote. ``merged_table`` reduces across batches; ``compact`` writes that as a new table.
    """
    columns = [*keys, *values, *order]
    events.sparkSession.createDataFrame([], events.select(*columns).schema).write.mode("overwrite").parquet(f"{folder}/batch=-1")

    def merge(batch: DataFrame, number: int) -> None:
        kept = upsert_latest(batch.select(*columns), keys, [*values, *order], order)
        kept.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_table(spark: SparkSession, folder: str, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """The last write of each key in all batches."""
    return upsert_latest(spark.read.parquet(folder), keys, [*values, *order], order)


def compact(spark: SparkSession, folder: str, to: str, keys: list[str], values: list[str], order: list[str]) -> None:
    """The merged table as the one batch of a new folder, for feeds of many batches: in between, with the feed stopped."""
    merged_table(spark, folder, keys, values, order).write.mode("overwrite").parquet(f"{to}/batch=-1")


def folder_feed(spark: SparkSession, folder: str, suffix: str = ".pdf", files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder tree as they arrive: (path, name, modified, length), any case of the suffix; bytes are not read."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.filter(F.lower("path").endswith(suffix)).select("path", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("name"), F.col("modificationTime").alias("modified"), "length")


def marker_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of marker files as they come; files of batches that are done are deleted."""
    return spark.readStream.option("cleanSource", "delete").text(folder)


def quiet_sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Bursts of events with no longer pause than ``gap``: one row a burst once it is over; events later than ``late`` are not waited for."""
    sessions = events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("burst"))
    return sessions.agg(F.count("*").alias("events")).select(*keys, F.col("burst.start").alias("start"), F.col("burst.end").alias("end"), "events")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What a stream gives for the data at hand, as a table in memory: for tests and small feeds."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    out = stream.sparkSession.table(name)
    return then(out) if then else out
