"""Structured Streaming counterparts of the event queue."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from kgspark import fixed
from kgspark.functions import text as X
from kgspark.session import run_dir

# How often each producer is looked at, in seconds.
POLL_SECONDS = 60
REPOSITORY_SECONDS = 21_600
WEB_SECONDS = 86_400


def read_files(spark: SparkSession, path: str, schema: StructType, files_per_trigger: Optional[int] = None) -> DataFrame:
    """Event files as a stream; ``path`` may be a glob."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def dedup(events: DataFrame, ttl_hours: int = fixed.EVENT_TTL_HOURS) -> DataFrame:
    """Drops repeats of (source_node, event_id) that arrive within the time to live.

    The watermark equals the time to live, so state is dropped when an event
    could no longer be delivered. Events without an id pass unchanged.
    """
    marked = events.withWatermark("queued_at", f"{ttl_hours} hours")
    # Events without an id get one of their own, so they never equal another.
    key = F.coalesce("event_id", F.concat(F.lit("anonymous-"), F.col("id").cast("string")))
    return marked.withColumn("dedup_id", key).dropDuplicatesWithinWatermark(["source_node", "dedup_id"]).drop("dedup_id")


def hourly_submissions(rows: DataFrame, user: str, ts: str, slide: str = "10 minutes") -> DataFrame:
    """Submissions per user and sliding hour, with the limit verdict."""
    counts = (
        rows.withWatermark(ts, "1 hour").groupBy(F.window(ts, "1 hour", slide), user)
        .agg(F.count("*").alias("n"))
    )
    return counts.select(
        F.col("window.start").alias("start"), F.col("window.end").alias("end"), user, "n",
        (F.col("n") > fixed.USER_RATE_PER_HOUR).alias("exceeded"))


def fold_failures(outcomes: DataFrame, old: DataFrame) -> DataFrame:
    """Consecutive failures per peer after a batch of poll outcomes (peer, at, ok).

    A success resets the count, so only the failures after a peer's last success
    matter. Both steps are aggregates with map-side partials: a peer with very
    many outcomes is counted in many tasks.
    """
    last_ok = outcomes.groupBy("peer").agg(F.max(F.when(F.col("ok"), F.col("at"))).alias("last_ok"))
    tail = outcomes.join(last_ok, "peer").groupBy("peer").agg(
        F.count_if(F.col("last_ok").isNull() | (F.col("at") > F.col("last_ok"))).alias("run"),
        F.max(F.col("last_ok").isNotNull()).alias("reset"),
    )
    failures = F.coalesce("run", F.lit(0)) + F.when(F.coalesce("reset", F.lit(False)), 0).otherwise(F.coalesce("failures", F.lit(0)))
    out = old.select("peer", "failures").join(tail, "peer", "full_outer").select("peer", failures.cast("int").alias("failures"))
    wait = F.when(F.col("failures") == 0, 0.0).otherwise(X.backoff_seconds(F.col("failures")))
    return out.withColumn("wait_seconds", wait).withColumn("skipped", F.col("failures") > fixed.MAX_PEER_FAILURES)


def to_table(stream: DataFrame, path: str, checkpoint: str, seconds: Optional[int] = None) -> StreamingQuery:
    """Appends a stream to a Parquet table; without ``seconds`` it drains what is there and stops."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds is not None else writer.trigger(availableNow=True)
    return writer.start(path)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Runs a stream over what is available and returns the table it wrote."""
    spark = stream.sparkSession
    path, checkpoint = run_dir(spark, label), run_dir(spark, label + "-checkpoint")
    to_table(stream, path, checkpoint).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
