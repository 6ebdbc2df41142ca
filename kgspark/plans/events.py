"""Registered queries: event queue, delivery, handler chain and cross-references."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark import fixed
from kgspark.operators import admission as A
from kgspark.operators import events as E
from kgspark.operators.store import write_version
from kgspark.plans import model_sql as M
from kgspark.plans.base import query
from kgspark.sources import tables as T

_NODE = fixed.NODE_RID_PREFIX + "peer9"
# The last day of the table: most earlier events have expired by then.
_NOW = "2024-01-30 12:00:00"


def _now():
    return F.lit(_NOW).cast("timestamp")


def _deliveries(spark, sf):
    """Events already delivered to the polling node: every third one."""
    return T.table(spark, sf, "events").filter(F.pmod(F.col("event_id"), F.lit(3)) == 0).select(
        F.col("event_id").cast("string").alias("event_id"), F.lit(_NODE).alias("node"))


_DELIVERED = f"delivered AS (SELECT event_id, '{_NODE}' AS node FROM queue WHERE id % 3 = 0)"
_PENDING = f"""pending AS (SELECT * FROM queue WHERE expires_at > TIMESTAMP '{_NOW}' AND event_id NOT IN (SELECT event_id FROM delivered WHERE node = '{_NODE}'))"""


@query("event_dedup", M.with_(M.EVENTS, """
twice AS (SELECT id, event_id, source_node, event_type, queued_at FROM queue
UNION ALL SELECT id + 1000000000, event_id, source_node, event_type, queued_at + INTERVAL 5 MINUTE FROM queue
UNION ALL SELECT id + 2000000000, CAST(NULL AS VARCHAR), source_node, event_type, queued_at FROM queue WHERE event_type = 'NEW')""") + """
SELECT id, event_id, source_node, event_type FROM twice QUALIFY event_id IS NULL OR row_number() OVER (PARTITION BY source_node, event_id ORDER BY queued_at, id) = 1""")
def event_dedup(spark, sf):
    ev = T.network_events(spark, sf).select("id", "event_id", "source_node", "event_type", "queued_at")
    late = ev.withColumn("id", F.col("id") + 1_000_000_000).withColumn("queued_at", F.col("queued_at") + F.expr("INTERVAL 5 MINUTES"))
    anonymous = ev.filter("event_type = 'NEW'").withColumn("id", F.col("id") + 2_000_000_000).withColumn("event_id", F.lit(None).cast("string"))
    return E.dedup(ev.unionByName(late).unionByName(anonymous)).drop("queued_at")


@query("event_ttl", M.with_(M.EVENTS) + f"""
SELECT count(*) FILTER (WHERE expires_at <= TIMESTAMP '{_NOW}') AS expired, count(*) FILTER (WHERE expires_at > TIMESTAMP '{_NOW}') AS live FROM queue""")
def event_ttl(spark, sf):
    return E.expired_count(T.network_events(spark, sf), _now())


@query("event_cleanup", M.with_(M.EVENTS) + f"""
SELECT id, event_id, rid, 'live' AS part FROM queue WHERE expires_at > TIMESTAMP '{_NOW}' UNION ALL SELECT id, event_id, rid, 'expired' FROM queue WHERE expires_at <= TIMESTAMP '{_NOW}'""")
def event_cleanup(spark, sf):
    """The rewritten queue, read back from its new version, and what was taken out."""
    live, gone = E.cleanup(T.network_events(spark, sf), _now())
    kept = spark.read.parquet(write_version(live, "queue"))
    columns = ["id", "event_id", "rid"]
    return kept.select(*columns, F.lit("live").alias("part")).unionByName(gone.select(*columns, F.lit("expired").alias("part")))


@query("event_poll", M.with_(M.EVENTS, _DELIVERED, _PENDING) + """
SELECT id, event_id, event_type, rid, source_node FROM (SELECT * FROM pending ORDER BY queued_at, id LIMIT 50)
WHERE rid LIKE '@NET@person:%'""")
def event_poll(spark, sf):
    batch = E.peek(T.network_events(spark, sf), _deliveries(spark, sf), _NODE, _now(), 50, ["Person"])
    return batch.select("id", "event_id", "event_type", "rid", "source_node")


@query("event_poll_fixed", M.with_(M.EVENTS, _DELIVERED, _PENDING) + """
SELECT id, event_id, event_type, rid, source_node FROM pending WHERE rid LIKE '@NET@person:%' ORDER BY queued_at, id LIMIT 50""")
def event_poll_fixed(spark, sf):
    batch = E.peek(T.network_events(spark, sf), _deliveries(spark, sf), _NODE, _now(), 50, ["Person"], filter_first=True)
    return batch.select("id", "event_id", "event_type", "rid", "source_node")


@query("event_peek_anti", M.with_(M.EVENTS, _DELIVERED, _PENDING) + """
SELECT source_node, event_type, count(*) AS waiting FROM pending GROUP BY ALL""")
def event_peek_anti(spark, sf):
    waiting = E.pending_for(T.network_events(spark, sf), _deliveries(spark, sf), _NODE, _now())
    return waiting.groupBy("source_node", "event_type").agg(F.count("*").alias("waiting"))


@query("mark_delivered", M.with_(M.EVENTS, _DELIVERED) + f"""
SELECT event_id, '{_NODE}' AS node FROM queue WHERE event_type <> 'FORGET' AND event_id NOT IN (SELECT event_id FROM delivered)""")
def mark_delivered(spark, sf):
    batch = T.network_events(spark, sf).filter("event_type <> 'FORGET'")
    return E.mark(_deliveries(spark, sf), batch, _NODE)


@query("push_all_or_nothing", M.with_(M.EVENTS, _DELIVERED) + f"""
SELECT event_id, '{_NODE}' AS node FROM queue WHERE event_type = 'NEW' AND event_id NOT IN (SELECT event_id FROM delivered)""")
def push_all_or_nothing(spark, sf):
    ev = T.network_events(spark, sf)
    batch = ev.filter("event_type = 'NEW'")
    return E.push_all_or_nothing(_deliveries(spark, sf), batch, ev.select("event_id"), _NODE)


@query("latest_bundle", M.with_(M.EVENTS) + """
SELECT rid, id, event_type, source_node, strftime(queued_at, '%Y-%m-%dT%H:%M:%S') AS queued_at FROM queue
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY queued_at DESC, id DESC) = 1""")
def latest_bundle(spark, sf):
    return E.latest_per_rid(T.network_events(spark, sf)).select(
        "rid", "id", "event_type", "source_node", F.date_format("queued_at", "yyyy-MM-dd'T'HH:mm:ss").alias("queued_at"))


@query("manifest_fetch", M.with_(M.EVENTS, """
wanted AS (SELECT '@NET@person:user-' || c_custkey AS rid FROM customer),
last AS (SELECT rid, id FROM queue QUALIFY row_number() OVER (PARTITION BY rid ORDER BY queued_at DESC, id DESC) = 1)""") + """
SELECT w.rid, CASE WHEN l.rid IS NULL THEN 'not_found' ELSE 'found' END AS status, coalesce(l.id, -1) AS id FROM wanted w LEFT JOIN last l USING (rid)""")
def manifest_fetch(spark, sf):
    wanted = T.table(spark, sf, "customer").select(F.concat(F.lit(fixed.NETWORK_RID_PREFIX + "person:user-"), F.col("c_custkey").cast("string")).alias("rid"))
    found, missing = E.fetch(wanted, T.network_events(spark, sf))
    return found.select("rid", F.lit("found").alias("status"), "id").unionByName(
        missing.select("rid", F.lit("not_found").alias("status"), F.lit(-1).cast("bigint").alias("id")))


@query("handler_chain", M.with_(M.EVENTS) + """
SELECT entity_type, event_type, count(*) AS events, count(DISTINCT name) AS names FROM
(SELECT 'Person' AS entity_type, event_type, name FROM queue WHERE NOT (rid = '@NET@person:user-5' AND source_node <> '@NET@person:user-5'))
GROUP BY ALL""")
def handler_chain(spark, sf):
    out = E.run_chain(T.network_events(spark, sf), E.default_chain(fixed.NETWORK_RID_PREFIX + "person:user-5"))
    return out.groupBy("entity_type", "event_type").agg(F.count("*").alias("events"), F.countDistinct("entity_name").alias("names"))


_FOLD = f"""
ev AS (SELECT q.rid, q.source_node, q.event_type, row_number() OVER (PARTITION BY q.rid, q.source_node ORDER BY q.queued_at, q.id) AS n,
 CASE WHEN c.c_name IS NULL THEN 'unresolved:Person:' || q.name ELSE {M.PERSON} END AS local_uri,
 CASE WHEN c.c_name IS NULL THEN 'unresolved' ELSE 'same_as' END AS relationship,
 CASE WHEN c.c_name IS NULL THEN 0.0 ELSE 1.0 END AS confidence FROM queue q LEFT JOIN customer c ON c.c_name = q.name),
walk AS (SELECT DISTINCT rid, source_node, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS local_uri, CAST(NULL AS VARCHAR) AS relationship, CAST(NULL AS DOUBLE) AS confidence FROM ev
 UNION ALL
 SELECT e.rid, e.source_node, e.n,
  CASE WHEN e.event_type = 'FORGET' THEN NULL WHEN take THEN e.local_uri ELSE w.local_uri END,
  CASE WHEN e.event_type = 'FORGET' THEN NULL WHEN take THEN e.relationship ELSE w.relationship END,
  CASE WHEN e.event_type = 'FORGET' THEN NULL WHEN take THEN e.confidence ELSE w.confidence END
 FROM walk w JOIN ev e ON e.rid = w.rid AND e.source_node = w.source_node AND e.n = w.n + 1,
 LATERAL (SELECT w.local_uri IS NULL OR (w.relationship = 'unresolved' AND e.relationship <> 'unresolved')
  OR (e.event_type = 'UPDATE' AND (w.local_uri <> e.local_uri OR w.relationship <> e.relationship)) AS take))"""


@query("crossref_upsert", M.with_(M.EVENTS, _FOLD, recursive=True) + """
SELECT rid, source_node, local_uri, relationship, confidence FROM walk w WHERE local_uri IS NOT NULL
AND n = (SELECT max(n) FROM ev e WHERE e.rid = w.rid AND e.source_node = w.source_node)""")
def crossref_upsert(spark, sf):
    events = E.parse_contents(T.network_events(spark, sf))
    return E.fold_cross_refs(E.resolution_rows(events, T.entity_registry(spark, sf, ["Person"])))


@query("trailing_hour_rate", M.with_(M.SUBMISSIONS, """
c AS (SELECT page_id, submitted_by,
 (SELECT count(*) FROM submissions b WHERE b.submitted_by = a.submitted_by AND b.created_at <= a.created_at AND b.created_at > a.created_at - INTERVAL 1 HOUR) AS user_hour,
 (SELECT count(*) FROM submissions b WHERE b.created_at <= a.created_at AND b.created_at > a.created_at - INTERVAL 1 HOUR) AS global_hour FROM submissions a)""") + """
SELECT *, CASE WHEN global_hour > 20 THEN 'global' WHEN user_hour > 5 THEN 'user' ELSE 'ok' END AS verdict FROM c""")
def trailing_hour_rate(spark, sf):
    rows = T.web_submissions(spark, sf).select("page_id", "submitted_by", "created_at")
    return E.trailing_hour(rows, "submitted_by", "created_at").drop("created_at")


@query("event_hour_rate", """
SELECT event_id, user_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND epoch_ns(b.ts) // 1000000000 <= epoch_ns(a.ts) // 1000000000
 AND epoch_ns(b.ts) // 1000000000 > epoch_ns(a.ts) // 1000000000 - 3600) AS user_hour,
(SELECT count(*) FROM events b WHERE epoch_ns(b.ts) // 1000000000 <= epoch_ns(a.ts) // 1000000000
 AND epoch_ns(b.ts) // 1000000000 > epoch_ns(a.ts) // 1000000000 - 3600) AS global_hour FROM events a""")
def event_hour_rate(spark, sf):
    rows = T.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return E.trailing_hour(rows, "user_id", "ts").drop("ts", "verdict")


@query("poll_authorised", M.with_(M.EVENTS, """
pairs AS (SELECT DISTINCT source_node AS target_node, '@NODE@self' AS source_node FROM queue),
edges AS (SELECT target_node, source_node, CASE WHEN target_node LIKE '%peer1' THEN ['Person'] ELSE CAST([] AS VARCHAR[]) END AS rid_types,
 CASE WHEN target_node LIKE '%peer0' THEN 'PROPOSED' ELSE 'APPROVED' END AS status FROM pairs)""") + """
SELECT target_node, source_node, coalesce(array_to_string(rid_types, ','), '') AS rid_types FROM edges WHERE status = 'APPROVED'""")
def poll_authorised(spark, sf):
    pairs = T.network_events(spark, sf).select(F.col("source_node").alias("target_node")).distinct().withColumn("source_node", F.lit(fixed.NODE_RID_PREFIX + "self"))
    edges = pairs.select(
        "*", F.when(F.col("target_node").endswith("peer1"), F.array(F.lit("Person"))).otherwise(F.array().cast("array<string>")).alias("rid_types"),
        F.when(F.col("target_node").endswith("peer0"), "PROPOSED").otherwise("APPROVED").alias("status"))
    return E.authorised(pairs, edges, strict=True).select("target_node", "source_node", F.coalesce(F.array_join("rid_types", ","), F.lit("")).alias("rid_types"))


@query("rate_limited_admission", """
WITH RECURSIVE s AS MATERIALIZED (SELECT event_id, 'user' || (user_id % 5) AS u, epoch_us(ts) // 12000000 AS sec, row_number() OVER (ORDER BY epoch_us(ts) // 12, event_id) AS n FROM events),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS event_id, CAST('' AS VARCHAR) AS verdict, CAST([] AS STRUCT(s BIGINT, u VARCHAR)[]) AS acc
 UNION ALL
 SELECT n, event_id, verdict, CASE WHEN verdict = 'ok' THEN list_append(live, {'s': sec, 'u': u}) ELSE live END FROM
 (SELECT *, CASE WHEN len(live) >= 20 THEN 'global' WHEN len(list_filter(live, lambda x: x.u = u)) >= 5 THEN 'user' ELSE 'ok' END AS verdict FROM
  (SELECT s.n, s.event_id, s.sec, s.u, list_filter(walk.acc, lambda x: x.s > s.sec - 3600) AS live FROM walk JOIN s ON s.n = walk.n + 1)))
SELECT event_id, verdict FROM walk WHERE n > 0""")
def rate_limited_admission(spark, sf):
    # The table's times run twelve times as fast, so that both limits are met.
    at = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 12))
    rows = T.table(spark, sf, "events").select("event_id", F.concat(F.lit("user"), F.pmod(F.col("user_id"), F.lit(5)).cast("string")).alias("submitted_by"), at.alias("created_at"))
    return A.admit(rows, "submitted_by", "created_at", "event_id").select("event_id", "verdict")
