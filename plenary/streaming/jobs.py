"""Incremental jobs on Structured Streaming.

The batch plans and these give equal results once a stream has seen the same
rows; queries run with AvailableNow, so they end when the input is read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Events of Parquet files that appear under ``path``."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def trending_windows(events: DataFrame, length: str = "24 hours", slide: str = "1 hour", late: str = "3 days") -> DataFrame:
    """Views in sliding windows; rows later than ``late`` are dropped and old windows' state goes."""
    views = events.where("event_type = 'view'").withWatermark("ts", late)
    return views.groupBy(F.window("ts", length, slide), "user_id").agg(F.count(F.lit(1)).alias("views")).select("window.start", "window.end", "user_id", "views")


def lifetime_counts(events: DataFrame) -> DataFrame:
    """Views of each user since the stream began; run in update or complete mode."""
    return events.where("event_type = 'view'").groupBy("user_id").agg(F.count(F.lit(1)).alias("views"))


def deduplicated(events: DataFrame, late: str = "3 days") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "3 days") -> DataFrame:
    """Sessions of users: events that follow each other within ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("events")).select("session_window.start", "session_window.end", "user_id", "events")


def run_available(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Run to the end of what is there; each batch goes to ``write``, which must be idempotent by batch number."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_batches(path: str, keys: list[str], columns: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that replaces rows of equal keys in a Parquet table.

    Each batch makes a new version of the table under ``path`` and then names it
    in a small file; a batch that is repeated writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.select(*columns)
        if number:
            old = spark.read.parquet(f"{path}/version={number - 1}")
            new = old.join(new.select(*keys), keys, "left_anti").select(*columns).unionByName(new)
        new.write.mode("overwrite").parquet(f"{path}/version={number}")

    return write
