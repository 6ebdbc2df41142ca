"""At-least-once delivery: what was handed to a node, and what the node confirmed.

A delivery round has a batch id. Its events are written before they are handed
out and its confirmations after, both under that id, so a round that is run
again offers the same events and replaces its own confirmations.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Optional

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kgspark.sources.shared_files import exists

#: Takes the offered events (with ``attempt``) and returns those it processed, with their ``event_id``.
Consumer = Callable[[DataFrame], DataFrame]


class DeliveryLog:
    """Deliveries to one node. ``schema`` is that of the events; they need event_id, queued_at and id."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path = spark, path
        self.schema = StructType(list(schema.fields)).add("attempt", "integer")

    def _read(self, part: str, schema: StructType, before: Optional[int]) -> DataFrame:
        folder = f"{self.path}/{part}"
        with_batch = StructType(list(schema.fields)).add("batch", "long")
        if not exists(folder):
            return self.spark.createDataFrame([], with_batch)
        rows = self.spark.read.schema(with_batch).parquet(folder)
        return rows if before is None else rows.filter(F.col("batch") < before)

    def delivered(self, before: Optional[int] = None) -> DataFrame:
        return self._read("delivered", self.schema, before)

    def confirmed(self, before: Optional[int] = None) -> DataFrame:
        return self._read("confirmed", StructType().add("event_id", "string"), before)

    def unconfirmed(self, before: Optional[int] = None) -> DataFrame:
        """The last delivery of each event that was never confirmed."""
        open_rows = self.delivered(before).drop("batch").join(self.confirmed(before).select("event_id"), "event_id", "left_anti")
        rest = [c for c in self.schema.names if c != "event_id"]
        last = open_rows.groupBy("event_id").agg(F.max_by(F.struct(*rest), "attempt").alias("r")).select("event_id", "r.*")
        return last.select(*self.schema.names)

    def offer(self, events: DataFrame, batch_id: int, now: Optional[Column] = None, limit: Optional[int] = None) -> DataFrame:
        """The events of a round: those never handed out, and again all that were never confirmed; oldest first where limited."""
        folder = f"{self.path}/delivered/batch={batch_id}"
        if not exists(f"{folder}/_SUCCESS"):
            fresh = events.dropDuplicates(["event_id"]).join(self.delivered(batch_id).select("event_id"), "event_id", "left_anti").withColumn("attempt", F.lit(1))
            again = self.unconfirmed(batch_id).withColumn("attempt", F.col("attempt") + 1)
            rows = fresh.select(*self.schema.names).unionByName(again)
            rows = rows if now is None else rows.filter(F.col("expires_at") > now)
            rows = rows if limit is None else rows.orderBy("queued_at", "id").limit(limit)
            rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(self.schema).parquet(folder)

    def round(self, events: DataFrame, batch_id: int, consume: Consumer, now: Optional[Column] = None, limit: Optional[int] = None) -> None:
        """Hands out one batch and confirms what the consumer returns of it; an error of the consumer confirms nothing."""
        offered = self.offer(events, batch_id, now, limit)
        done = consume(offered).select("event_id").distinct()
        done.write.mode("overwrite").parquet(f"{self.path}/confirmed/batch={batch_id}")

    def last_batch(self) -> int:
        return self.delivered().agg(F.max("batch")).first()[0] or 0

    def settle(self, consume: Consumer, rounds: int) -> int:
        """Further rounds, without new events, until all is confirmed or ``rounds`` have passed; returns how many ran."""
        nothing = self.spark.createDataFrame([], StructType(self.schema.fields[:-1]))
        for k in range(rounds):
            if self.unconfirmed().isEmpty():
                return k
            self.round(nothing, self.last_batch() + 1, consume)
        return rounds


def deliver_stream(events: DataFrame, log: DeliveryLog, consume: Consumer, checkpoint: str, seconds: Optional[float] = None) -> StreamingQuery:
    """A delivery round per micro-batch: its events, and again those that were never confirmed."""
    writer = events.writeStream.foreachBatch(lambda batch, batch_id: log.round(batch, batch_id, consume)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds is not None else writer.trigger(availableNow=True)).start()
