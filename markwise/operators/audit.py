"""Hash-chained event logs: append, recompute, verify.

An event's hash covers the hash of the event before it, so a chain is a sequential fold. It runs as a higher-order
function over the ordered events of one chain, inside the JVM; different chains run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash that stands before the first event.
GENESIS = ""


def event_hash(previous: Column, position: Column, payload_hash: Column) -> Column:
    """Hash of one event over the hash before it, its position and its payload's hash."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", previous, position.cast("string"), payload_hash), 256))


def payload_hash(*parts: Column) -> Column:
    """Hash of a payload given as texts; null parts count as empty."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256))


def chained(events: DataFrame, chain: str, order: list[str], payload: str = "payload_hash") -> DataFrame:
    """chain, event_pos (from 1), payload_hash, previous_hash, event_hash of every event, in the given order.

    Events of null chains are left out; an empty table gives no row. One chain, a single log, is held by one task.
    """
    logs = events.where(F.col(chain).isNotNull()).groupBy(chain).agg(F.sort_array(F.collect_list(F.struct(*[F.col(o) for o in order], F.col(payload).alias("__payload")))).alias("log"))
    none = F.expr("cast(array() as array<struct<event_pos:int,payload_hash:string,previous_hash:string,event_hash:string>>)")

    def step(done: Column, event: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["event_hash"], F.lit(GENESIS))
        position = (F.size(done) + 1).cast("int")
        return F.concat(done, F.array(F.struct(position.alias("event_pos"), event["__payload"].alias("payload_hash"), before.alias("previous_hash"), event_hash(before, position, event["__payload"]).alias("event_hash"))))

    return logs.select(chain, F.inline(F.aggregate("log", none, step)))


def broken(log: DataFrame, chain: str) -> DataFrame:
    """chain, event_pos, fault of every event whose link or hash does not hold: previous_hash or event_hash."""
    before = F.coalesce(F.lag("event_hash").over(Window.partitionBy(chain).orderBy("event_pos")), F.lit(GENESIS))
    checked = log.withColumn("faults", F.array_compact(F.array(F.when(~F.col("previous_hash").eqNullSafe(before), "previous_hash"), F.when(~F.col("event_hash").eqNullSafe(event_hash(F.col("previous_hash"), F.col("event_pos"), F.col("payload_hash"))), "event_hash"))))
    return checked.select(chain, "event_pos", F.explode("faults").alias("fault"))


def appended(log: DataFrame, news: DataFrame, chain: str, order: list[str]) -> DataFrame:
    """The log with ``news`` (chain, order, payload_hash) chained behind each chain's last event."""
    ends = log.groupBy(chain).agg(F.max(F.struct("event_pos", "event_hash")).alias("end"))
    logs = news.where(F.col(chain).isNotNull()).groupBy(chain).agg(F.sort_array(F.collect_list(F.struct(*[F.col(o) for o in order], F.col("payload_hash").alias("__payload")))).alias("log")).join(ends, chain, "left")
    none = F.expr("cast(array() as array<struct<event_pos:int,payload_hash:string,previous_hash:string,event_hash:string>>)")
    first, start = F.coalesce("end.event_pos", F.lit(0)), F.coalesce("end.event_hash", F.lit(GENESIS))

    def step(done: Column, event: Column) -> Column:
        before = F.coalesce(F.try_element_at(done, F.lit(-1))["event_hash"], start)
        position = (F.size(done) + first + 1).cast("int")
        return F.concat(done, F.array(F.struct(position.alias("event_pos"), event["__payload"].alias("payload_hash"), before.alias("previous_hash"), event_hash(before, position, event["__payload"]).alias("event_hash"))))

    return log.unionByName(logs.select(chain, F.inline(F.aggregate("log", none, step))))
