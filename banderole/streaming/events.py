"""Period aggregates over a stream of events: late rows count until the watermark passes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def period_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(period_start, event_type, events, value); works on streams and on tables alike."""
    out = events.withWatermark("ts", late) if events.isStreaming else events
    return (
        out.groupBy(F.window("ts", window).alias("w"), "event_type")
        .agg(F.count("*").alias("events"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("period_start"), "event_type", "events", "value")
    )


def write_periods(periods: DataFrame, path: str, checkpoint: str):
    """Finished periods to Parquet; restarts go on from the checkpoint."""
    return periods.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
