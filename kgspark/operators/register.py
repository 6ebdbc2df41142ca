"""Registration of notes as entities: resolve, map, merge aliases, promote what waited, and announce it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark import fixed
from kgspark.functions import text as X
from kgspark.operators import notes as N
from kgspark.operators import sequential as Q
from kgspark.operators import store as S
from kgspark.session import cut_lineage


class Registered(NamedTuple):
    """Tables after a batch, the edges that no longer wait, and one event per registration."""

    registry: DataFrame
    mappings: DataFrame
    promoted: DataFrame
    events: DataFrame


def register(batch: DataFrame, registry: DataFrame, mappings: DataFrame, pending: DataFrame, order: str) -> Registered:
    """Registers notes in ``order`` (a unique column), each seeing what those before it created.

    ``batch`` is (vault_rid, vault_path, name, entity_type, content_hash,
    aliases, order), ``registry`` also carries vault_rid and koi_rid. A later
    registration of a vault_rid replaces its mapping. Aliases are added in their
    normalised form; an entity keeps its first vault_rid and its koi_rid. An event says NEW for
    the registration that made the entity, else UPDATE.
    """
    spark = batch.sparkSession
    no_links = spark.createDataFrame([], "document_rid string, entity_uri string, mention_count long")
    asked = batch.select(F.col(order).cast("string").alias("mention_id"), F.col("vault_rid").alias("document_rid"), "name", "entity_type", order)
    done, new, _ = Q.ingest_in_order(asked, registry, no_links, order)
    rows = cut_lineage(batch.join(done.select(F.col("mention_id").alias("__id"), F.col("uri").alias("canonical_uri"), "is_new"), F.col(order).cast("string") == F.col("__id")).drop("__id"), "registered")
    mapped = rows.select("vault_rid", "vault_path", "canonical_uri", "entity_type", "name", "content_hash", F.lit("linked").alias("sync_status"), order)
    after = S.upsert_latest(mappings.withColumn(order, F.lit(None).cast(mapped.schema[order].dataType)), mapped, ["vault_rid"], order).drop(order)

    given = F.filter(F.col("aliases"), lambda a: F.coalesce(a, F.lit("")) != "")
    each = rows.select("canonical_uri", F.explode_outer(F.transform(given, X.normalize_alias)).alias("alias"), "vault_rid", order)
    # Distinct aliases of one entity, however many registrations name it.
    more = each.groupBy("canonical_uri").agg(F.array_sort(F.collect_set("alias")).alias("more"), F.min_by("vault_rid", order).alias("first_rid"))
    known = registry.select("uri", "entity_text", "entity_type", "normalized_text", "aliases", "vault_rid", "koi_rid").unionByName(new.select(
        "uri", "entity_text", "entity_type", "normalized_text", F.array().cast("array<string>").alias("aliases"),
        F.lit(None).cast("string").alias("vault_rid"), F.lit(None).cast("string").alias("koi_rid")))
    named = known.join(more, F.col("uri") == F.col("canonical_uri"), "left")
    touched = F.col("canonical_uri").isNotNull()
    rid = X.network_rid(F.col("entity_type"), F.col("normalized_text"), F.col("uri"))
    out = cut_lineage(named.select(
        "uri", "entity_text", "entity_type", "normalized_text",
        F.when(touched & (F.size("more") > 0), S.merge_distinct(F.col("aliases"), F.col("more"))).otherwise(F.col("aliases")).alias("aliases"),
        F.coalesce("vault_rid", "first_rid").alias("vault_rid"), F.when(touched, F.coalesce("koi_rid", rid)).otherwise(F.col("koi_rid")).alias("koi_rid")), "registry")

    promoted = N.promote_pending(pending, new)
    said = F.to_json(F.struct("name", F.concat(F.lit(fixed.TYPE_PREFIX), "entity_type").alias("@type"), "entity_type", F.lit("vault").alias("source")))
    events = rows.join(out.select(F.col("uri").alias("canonical_uri"), F.col("koi_rid").alias("rid")), "canonical_uri").select(
        order, "rid", F.when(F.col("is_new"), "NEW").otherwise("UPDATE").alias("event_type"), said.alias("contents"))
    return Registered(out, after, promoted, events)
