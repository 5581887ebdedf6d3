"""Streaming queries over the events table, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.sources.tables import table
from pageloom.storage import shared_folder
from pageloom.streaming import feeds


def stream_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings log as a stream of files, merged batch by batch: the last write of each user's setting."""
    schema = table(spark, sf_dir, "events").schema
    files = f"{sf_dir.rstrip('/')}/events.parque[t]"  # a pattern, as the table may be one file
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(files)
    folder = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    columns = ["user_id", "event_type"], ["value"], ["ts", "event_id"]
    feeds.merge_batches(events, f"{folder}/table", *columns, f"{folder}/state").awaitTermination()
    return feeds.merged_table(spark, f"{folder}/table", *columns).select("user_id", "event_type", "value")


def quiet_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events with pauses of under six hours."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return feeds.quiet_sessions(events, ["user_id"], "ts", "6 hours", "1 day").select("user_id", "start", "events")


QUERIES = {f.__name__: f for f in (stream_settings, quiet_sessions)}
ORACLES = {
    "stream_settings": "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL",
    "quiet_sessions": """SELECT user_id, min(ts) AS start, count(*) AS events FROM (
      SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM (
        SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOURS AS gap FROM events)) GROUP BY user_id, burst""",
}
