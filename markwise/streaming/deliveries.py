"""Streams of attempts: deliveries once, and running figures by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from markwise.operators.instants import with_instant


def first_deliveries(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Deliveries whose (attempt_id, submitted_at) was not seen within ``late``; the state is dropped behind the watermark."""
    stamped = stream.withColumn("received", F.col("received_at").cast("timestamp"))
    return stamped.withWatermark("received", late).dropDuplicatesWithinWatermark(["attempt_id", "submitted_at"])


def deliveries_by_window(stream: DataFrame, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """begin, organization_id, deliveries: late rows beyond ``late`` behind the newest are not counted any more."""
    stamped = stream.withColumn("received", F.col("received_at").cast("timestamp")).withWatermark("received", late)
    return stamped.groupBy(F.window("received", length).alias("w"), "organization_id").agg(F.count("*").alias("deliveries")).select(F.col("w.start").alias("begin"), "organization_id", "deliveries")


def with_moment(stream: DataFrame, settings: DataFrame) -> DataFrame:
    """The stream with submitted_us, by a join with the small table of organisations; the same expressions as in batch."""
    joined = stream.join(settings.select("organization_id", "time_zone", "day_first"), "organization_id", "left")
    return with_instant(joined, "submitted_at", "time_zone", "day_first", "submitted_us")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything now available, written to an in-memory table; for tests and backfills."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return query
