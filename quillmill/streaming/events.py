"""Event streams: channels, latest event per key, last events, windows and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, at: str = "ts", per_trigger: int = 100) -> DataFrame:
    """Event files as a stream; the event time becomes an instant, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path).withColumn(at, F.col(at).cast("timestamp"))


def channel(events: DataFrame, keep: Column) -> DataFrame:
    """Events of one tenant or topic."""
    return events.filter(keep)


def latest_event(events: DataFrame, keys: list[str], at: str, event_id: str, values: list[str]) -> DataFrame:
    """The newest event of each key (by time, then id); the same for a table and, in update or complete mode, for a stream.

    State is one row per key. Events without key or time are left out.
    """
    kept = events.filter(F.col(at).isNotNull())
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    newest = F.max_by(F.struct(*values), F.struct(at, event_id)).alias("_v")
    return kept.groupBy(*keys).agg(newest, F.max(at).alias("last_at"), F.count("*").alias("events")).select(*keys, "last_at", "events", *[F.col(f"_v.{v}").alias(v) for v in values])


def deduplicated(events: DataFrame, event_id: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([event_id])


def windowed(events: DataFrame, at: str, width: str, keys: list[str], value: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Count and sum per key in tumbling or sliding windows; later events than `late` are dropped by a stream."""
    base = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(at, width, slide) if slide else F.window(at, width)
    out = base.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "events", "total")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Sessions per key that end after `gap` without event."""
    base = events.withWatermark(at, late) if events.isStreaming else events
    out = base.groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("events"))
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def write_snapshots(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete"):
    """Writes the state after each trigger as a table and stops when all files are read; returns the query."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
