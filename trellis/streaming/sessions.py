"""Streaming replay of events: sessions that end after thirty quiet minutes.

The original keeps sessions in memory and evicts them by the same gap; watermarks are an extension here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import SESSION_GAP


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def session_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Closed sessions by user; events later than the watermark are dropped, state is bounded by it."""
    keyed = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", SESSION_GAP).alias("w"))
    return keyed.agg(F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select("user_id", "n_events", "first_ts", "last_ts")
