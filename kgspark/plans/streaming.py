"""Registered queries: streaming counterparts, run over the events until drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.plans import model_sql as M
from kgspark.plans.base import query
from kgspark.plans.events import _FOLD
from kgspark.session import run_dir
from kgspark.sources import peers as P
from kgspark.sources import tables as T
from kgspark.streaming import delivery as D
from kgspark.streaming import queue as Q
from kgspark.streaming import state as K


def _event_stream(spark, sf):
    """The events file as a stream, shaped like the batch queue (through the same view)."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return T.as_queue(Q.read_files(spark, f"{sf}/events.parquet*", schema))


def _peer_stream(spark, sf):
    """The queue as its peers' files, read one file of each peer at a time: three micro-batches at least."""
    events = T.network_events(spark, sf).withColumn("peer", F.col("source_node"))
    folder = run_dir(spark, "peers")
    P.write_peer_files(events, f"{folder}/in", "queued_at", 3)
    return P.read_peers(spark, f"{folder}/in", events.schema, f"{folder}/progress", files_per_trigger=1)


def _drained(spark, query, path, schema):
    """The changes that a fold wrote once nothing is left to read."""
    query.processAllAvailable()
    query.stop()
    return spark.read.schema(schema + ", batch long").parquet(path)


@query("stream_dedup", M.with_(M.EVENTS) + "SELECT id, event_id, source_node, event_type FROM queue")
def stream_dedup(spark, sf):
    ev = _event_stream(spark, sf).select("id", "event_id", "source_node", "event_type", "queued_at")
    # Every event arrives twice, the copy under another id; ids are dropped, so which one stays does not matter.
    twice = ev.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return Q.drain(Q.dedup(twice).select("id", "event_id", "source_node", "event_type"), "stream-dedup")


@query("stream_hour_rate", """
WITH w AS (SELECT user_id, ts, unnest(range(0, 6)) AS i FROM events),
b AS (SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(CAST(i * 10 AS INTEGER)) AS s FROM w),
c AS (SELECT s, user_id, count(*) AS n FROM b GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, user_id, n, n > 5 AS exceeded FROM c WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_hour_rate(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = Q.read_files(spark, f"{sf}/events.parquet*", schema).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    counts = Q.hourly_submissions(rows, "user_id", "ts")
    return Q.drain(counts.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "user_id", "n", "exceeded"), "stream-rate")


@query("stream_crossref", M.with_(M.EVENTS, _FOLD, recursive=True) + """
SELECT rid, source_node, local_uri, relationship, confidence FROM walk w WHERE local_uri IS NOT NULL
AND n = (SELECT max(n) FROM ev e WHERE e.rid = w.rid AND e.source_node = w.source_node)""")
def stream_crossref(spark, sf):
    state = run_dir(spark, "crossref")
    query = K.fold_cross_refs(_peer_stream(spark, sf), T.entity_registry(spark, sf, ["Person"]), f"{state}/changes", f"{state}/checkpoint", 0)
    changes = _drained(spark, query, f"{state}/changes", K.CrossRefFold.SCHEMA)
    return K.cross_refs(changes).select("rid", "source_node", "local_uri", "relationship", "confidence")


@query("stream_peer_failures", """
WITH e AS (SELECT 'peer' || (user_id % 40) AS peer, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS n FROM events),
l AS (SELECT peer, count(*) - coalesce(max(n) FILTER (WHERE ok), 0) AS failures FROM e GROUP BY peer)
SELECT peer, CAST(failures AS INTEGER) AS failures, CASE WHEN failures = 0 THEN 0.0 ELSE least(30.0 * pow(2, failures - 1), 600.0) END AS wait_seconds, failures > 3 AS skipped FROM l""")
def stream_peer_failures(spark, sf):
    return _failures(spark, sf).select("peer", "failures", "wait_seconds", "skipped")


def _failures(spark, sf):
    """Outcomes of polls (an error event is a failed one) as a stream in three micro-batches, folded per peer."""
    outcomes = T.table(spark, sf, "events").select(
        F.concat(F.lit("peer"), F.pmod(F.col("user_id"), F.lit(40)).cast("string")).alias("peer"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("ok"))
    state = run_dir(spark, "failures")
    P.write_peer_files(outcomes, f"{state}/in", "at", 3)
    stream = P.read_peers(spark, f"{state}/in", outcomes.schema, f"{state}/progress", files_per_trigger=1)
    return K.failure_state(_drained(spark, K.track_failures(stream, f"{state}/changes", f"{state}/checkpoint", 0), f"{state}/changes", K.FailureFold.SCHEMA))


@query("stream_peer_backoff", """
WITH e AS (SELECT 'peer' || (user_id % 40) AS peer, ts, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id % 40 ORDER BY ts, event_id) AS n FROM events),
l AS (SELECT peer, max(ts) AS last, count(*) - coalesce(max(n) FILTER (WHERE ok), 0) AS failures FROM e GROUP BY peer),
w AS (SELECT *, CASE WHEN failures = 0 THEN 0.0 ELSE least(30.0 * pow(2, failures - 1), 600.0) END AS wait_seconds FROM l)
SELECT peer, CAST(failures AS INTEGER) AS failures,
 CASE WHEN failures > 0 THEN strftime(last + to_milliseconds(CAST(wait_seconds * 1000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS due,
 failures > 0 AND last + to_milliseconds(CAST(wait_seconds * 1000 AS BIGINT)) <= (SELECT max(ts) FROM events) AS is_due FROM w""")
def stream_peer_backoff(spark, sf):
    return _failures(spark, sf).select("peer", "failures", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"), "is_due")


@query("stream_peer_source", M.with_(M.EVENTS) + """
SELECT source_node, event_type, count(*) AS events, count(DISTINCT rid) AS rids, min(id) AS first_id, max(id) AS last_id FROM queue GROUP BY ALL""")
def stream_peer_source(spark, sf):
    out, checkpoint = run_dir(spark, "peer-events"), run_dir(spark, "peer-events-checkpoint")
    query = Q.to_table(_peer_stream(spark, sf).drop("peer"), out, checkpoint, 0)
    query.processAllAvailable()
    query.stop()
    rows = spark.read.parquet(out)
    return rows.groupBy("source_node", "event_type").agg(
        F.count("*").alias("events"), F.countDistinct("rid").alias("rids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("stream_confirmed_delivery", M.with_(M.EVENTS) + """
SELECT event_id, source_node, CAST(id % 3 + 1 AS INTEGER) AS attempts, true AS confirmed FROM queue""")
def stream_confirmed_delivery(spark, sf):
    events = _peer_stream(spark, sf).drop("peer")
    folder = run_dir(spark, "delivery")
    log = D.DeliveryLog(spark, f"{folder}/log", events.schema)

    def consume(offered):  # fails at an event up to twice
        return offered.filter(F.col("attempt") > F.pmod(F.col("id"), F.lit(3)))

    query = D.deliver_stream(events, log, consume, f"{folder}/checkpoint", 0)
    query.processAllAvailable()
    query.stop()
    log.settle(consume, 3)
    tries = log.delivered().groupBy("event_id", "source_node").agg(F.max("attempt").alias("attempts"))
    return tries.join(log.confirmed().select("event_id", F.lit(True).alias("confirmed")), "event_id", "left")
