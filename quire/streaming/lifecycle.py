"""The log of runs as an append-only table: each event once, however often and in whatever order it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "run_id string, event_id bigint, at timestamp, status string"


def logged(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of ``events`` (run_id, event_id, at, status) without repeats: of events with one id that come within ``late`` of each other the first counts. The state kept is that of ``late``."""
    rows = events.select(F.col("run_id").cast("string").alias("run_id"), F.col("event_id").cast("bigint").alias("event_id"), F.col("at").cast("timestamp").alias("at"), "status")
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["run_id", "event_id"])


def append(events: DataFrame, path: str, checkpoint: str, late: str = "1 hour") -> None:
    """Append what the stream has to the log at ``path`` and stop. Files are only ever added, and one batch writes once, also when it runs again."""
    logged(events, late).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)
