"""Registered queries: upserts, merges and deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark.functions.canonical import canonical_sha256
from kgspark.operators import store as S
from kgspark.plans import model_sql as M
from kgspark.plans.base import query
from kgspark.sources import tables as T


def _events(spark, sf):
    return T.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("k"), "event_type", "value", F.when(F.col("event_type") != "view", F.col("props")).alias("props"), "ts")


def _halves(spark, sf):
    """Events of January's first half as the stored table, the rest as the batch."""
    ev = _events(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return ev.filter(F.col("ts") < cut), ev.filter(F.col("ts") >= cut)


_HALVES = """
ev AS (SELECT event_id, user_id AS k, event_type, value, CASE WHEN event_type <> 'view' THEN props END AS props, ts FROM events),
old AS (SELECT * FROM ev WHERE ts < TIMESTAMP '2024-01-16'), new AS (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-16')"""


@query("insert_ignore", M.with_(_HALVES) + """
SELECT event_id, k, event_type FROM (SELECT * FROM old WHERE event_type = 'error' UNION ALL
(SELECT * FROM new WHERE (k, event_type) NOT IN (SELECT (k, event_type) FROM old WHERE event_type = 'error')
 QUALIFY row_number() OVER (PARTITION BY k, event_type ORDER BY event_id) = 1))""")
def insert_ignore(spark, sf):
    old, new = _halves(spark, sf)
    return S.insert_ignore(old.filter("event_type = 'error'"), new, ["k", "event_type"], "event_id").select("event_id", "k", "event_type")


@query("upsert_latest", M.with_(_HALVES) + """
SELECT k, event_type, event_id, value FROM ev QUALIFY row_number() OVER (PARTITION BY k, event_type ORDER BY ts >= TIMESTAMP '2024-01-16' DESC, event_id DESC) = 1""")
def upsert_latest(spark, sf):
    old, new = _halves(spark, sf)
    return S.upsert_latest(old, new, ["k", "event_type"], "event_id").select("k", "event_type", "event_id", "value")


@query("upsert_increment", M.with_(_HALVES) + """
SELECT k, event_type, count(*) AS n, arg_min(value, event_id) AS context FROM ev GROUP BY k, event_type""")
def upsert_increment(spark, sf):
    old, new = _halves(spark, sf)
    stored = old.groupBy("k", "event_type").agg(F.count("*").alias("n"), F.min_by("value", "event_id").alias("context"), F.min("event_id").alias("event_id"))
    batch = new.select("k", "event_type", F.lit(1).cast("bigint").alias("n"), F.col("value").alias("context"), "event_id")
    return S.upsert_increment(stored, batch, ["k", "event_type"], "n", "context", "event_id")


@query("coalesce_merge", M.with_(_HALVES, """
o AS (SELECT k, arg_max(value, event_id) AS value, arg_max(coalesce(props,''), event_id) AS p FROM old WHERE event_type IN ('view','click') GROUP BY k),
n AS (SELECT k, arg_max(value, event_id) AS value, arg_max(coalesce(props,''), event_id) AS p FROM new WHERE event_type IN ('view','signup') GROUP BY k)""") + """
SELECT k, CASE WHEN n.k IS NOT NULL THEN n.value ELSE o.value END AS value, coalesce(nullif(n.p,''), nullif(o.p,'')) AS props FROM o FULL JOIN n USING (k)""")
def coalesce_merge(spark, sf):
    old, new = _halves(spark, sf)
    last = lambda df, kinds: df.filter(F.col("event_type").isin(kinds)).groupBy("k").agg(
        F.max_by("value", "event_id").alias("value"), F.nullif(F.max_by(F.coalesce("props", F.lit("")), "event_id"), F.lit("")).alias("props"))
    return S.coalesce_merge(last(old, ["view", "click"]), last(new, ["view", "signup"]), ["k"], ["props"])


@query("replace_source", M.with_(_HALVES) + """
SELECT event_id, k, event_type FROM old WHERE k NOT IN (SELECT k FROM new WHERE event_type = 'signup') UNION ALL SELECT event_id, k, event_type FROM new WHERE event_type = 'signup'""")
def replace_source(spark, sf):
    old, new = _halves(spark, sf)
    cols = ["event_id", "k", "event_type"]
    return S.replace_source(old.select(cols), new.filter("event_type = 'signup'").select(cols), "k")


@query("array_merge_distinct", """
SELECT c_custkey, array_to_string(list_sort(list_distinct(['cust ' || c_custkey, lower(c_mktsegment), lower(c_name), 'cust ' || (c_custkey % 10)])), ',') AS aliases,
CASE WHEN c_custkey % 10 = c_custkey THEN 1 ELSE 2 END AS delivered FROM customer""")
def array_merge_distinct(spark, sf):
    cust = lambda c: F.concat(F.lit("cust "), c.cast("string"))
    stored = F.array(cust(F.col("c_custkey")), F.lower("c_mktsegment"))
    new = F.array(F.lower("c_name"), cust(F.pmod(F.col("c_custkey"), F.lit(10))))
    appended = S.append_if_absent(F.array(cust(F.col("c_custkey"))), cust(F.pmod(F.col("c_custkey"), F.lit(10))))
    return T.table(spark, sf, "customer").select(
        "c_custkey", F.array_join(S.merge_distinct(stored, new), ",").alias("aliases"), F.size(appended).alias("delivered"))


@query("cascade_delete", M.with_(M.EDGES, M.LINKS, "gone AS (SELECT " + M.ORG + " AS uri FROM supplier WHERE s_acctbal < 0)") + """
SELECT 'edges' AS part, count(*) AS n FROM edges WHERE subject_uri NOT IN (SELECT uri FROM gone) AND object_uri NOT IN (SELECT uri FROM gone)
UNION ALL SELECT 'links', count(*) FROM links WHERE entity_uri NOT IN (SELECT uri FROM gone)""")
def cascade_delete(spark, sf):
    gone = T.table(spark, sf, "supplier").filter("s_acctbal < 0").select(T.org_uri().alias("uri"))
    gone = T.numbered_registry(spark, sf, ["Organization"]).join(gone, "uri", "left_semi").select(F.col("id").alias("uri"))
    edges, links = S.cascade_delete(gone, [(T.relationships(spark, sf, ids=True), ["subject_uri", "object_uri"]), (T.document_links(spark, sf, ids=True), ["entity_uri"])])
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(edges, "edges").unionByName(count(links, "links"))


@query("fill_descriptions", """
SELECT doc_id, CASE WHEN lang IN ('en','fr') THEN lang || ':' || source ELSE source END AS description FROM documents""")
def fill_descriptions(spark, sf):
    has = F.when(F.col("lang") == "de", F.lit("")).when(F.col("lang").isin("en", "fr"), F.concat_ws(":", "lang", "source"))
    return T.table(spark, sf, "documents").select("doc_id", S.fill_when_empty(has, F.col("source")).alias("description"))


@query("canonical_hash", M.with_(M.EVENTS) + """
SELECT id, sha256('{"@type":"bkc:Person","k":' || k || ',"name":"' || name || '"}') AS digest FROM queue""")
def canonical_hash(spark, sf):
    return T.network_events(spark, sf).select("id", canonical_sha256(F.col("contents")).alias("digest"))
