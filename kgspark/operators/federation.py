"""Nodes and peers: poll plans, envelopes and bootstrap keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark import fixed
from kgspark.functions import text as X


def poll_plan(edges: DataFrame, nodes: DataFrame, self_rid: str, kind: str = "POLL") -> DataFrame:
    """Approved edges of this node joined with the other end: its sources to poll, or its targets to push to."""
    mine, other = ("target_node", "source_node") if kind == "POLL" else ("source_node", "target_node")
    chosen = edges.filter((F.col("edge_type") == kind) & (F.col("status") == "APPROVED") & (F.col(mine) == self_rid))
    return chosen.join(nodes.select(F.col("node_rid").alias(other), "node_name", "base_url"), other)


def due_peers(plan: DataFrame, failures: DataFrame) -> DataFrame:
    """Peers with their waiting time; those beyond the failure bound are left out."""
    n = F.coalesce("failures", F.lit(0))
    wait = F.when(n == 0, 0.0).otherwise(X.backoff_seconds(n))
    return plan.join(failures.select(F.col("peer").alias("source_node"), "failures"), "source_node", "left").filter(
        n <= fixed.MAX_PEER_FAILURES).withColumn("wait_seconds", wait).drop("failures")


def node_rid(name: Column, key: Column, mode: str = "b64_64") -> Column:
    """Node identifier of a public key (base64 text): hash of the text, its first 16 digits, or of the raw bytes."""
    digest = F.sha2(F.unbase64(key), 256) if mode == "der64" else F.sha2(key, 256)
    digest = F.substring(digest, 1, 16) if mode == "legacy16" else digest
    return F.concat(F.lit(fixed.NODE_RID_PREFIX), name, F.lit("+"), digest)


def key_matches(rid: Column, key: Column) -> Column:
    """True when the hash in a node identifier belongs to the key under any accepted mode."""
    name = F.regexp_extract(rid, r":([^:+]+)\+", 1)
    return F.coalesce(*[F.when(node_rid(name, key, m) == rid, F.lit(True)) for m in ("b64_64", "legacy16", "der64")], F.lit(False))


def bootstrap_keys(payloads: DataFrame) -> DataFrame:
    """Public keys that unknown senders announce about themselves.

    ``payloads`` is (source_node, events) with an array of events; the key of
    the first NEW event about the sender itself counts if its hash matches.
    """
    own = F.filter("events", lambda e: (e["event_type"] == "NEW") & (e["rid"] == F.col("source_node")))
    keys = F.transform(own, lambda e: F.get_json_object(e["contents"], "$.public_key"))
    key = F.get(F.filter(keys, lambda k: k.isNotNull()), F.lit(0))
    out = payloads.select("source_node", key.alias("public_key")).filter("public_key IS NOT NULL")
    return out.filter(key_matches(F.col("source_node"), F.col("public_key"))).groupBy("source_node").agg(F.min("public_key").alias("public_key"))


def envelope_problem(payload: Column, source: Column, target: Column, signature: Column, self_rid: str) -> Column:
    """Why an envelope is refused before its signature is checked; null when its form is right."""
    prefix = fixed.NODE_RID_PREFIX
    return (
        F.when(payload.isNull(), "missing payload")
        .when(source.isNull() | ~source.startswith(prefix), "bad source")
        .when(target.isNull() | (target != self_rid), "wrong target")
        .when(signature.isNull() | (F.length(F.unbase64(signature)) != 64), "bad signature form")
    )


def merge_peers(old: DataFrame, new: DataFrame) -> DataFrame:
    """Peer records after a handshake; ontology fields survive a record without them."""
    from kgspark.operators.store import coalesce_merge

    return coalesce_merge(old, new, ["node_rid"], ["ontology_uri", "ontology_version"])
