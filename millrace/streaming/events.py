"""Streaming ingestion of the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [T.StructField("event_id", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("user_id", "job_id", "event_type", "from_state", "to_state", "specialty_name", "classification_confidence")]
    + [T.StructField("dwell_ms", T.IntegerType()), T.StructField("override_reason", T.StringType()), T.StructField("recorded_at", T.TimestampType())]
)
#: Events come up to six days late.
LATENESS = "7 days"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of event files."""
    return spark.readStream.schema(EVENT).parquet(folder)


def deduplicated(events: DataFrame) -> DataFrame:
    """Events once each; state is dropped once the watermark has passed."""
    return events.withWatermark("recorded_at", LATENESS).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(events: DataFrame) -> DataFrame:
    """Events per day and type, late ones included up to the watermark."""
    return events.withWatermark("recorded_at", LATENESS).groupBy(F.window("recorded_at", "1 day"), "event_type").count()


def append_events(events: DataFrame, folder: str, checkpoint: str):
    """Write the stream of deduplicated events to ``folder`` and return the running query."""
    return deduplicated(events).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
