"""Entity lookups, counts, links and neighbourhoods over registry, edges and links."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Optional

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from kgspark import fixed
from kgspark.functions import text as X
from kgspark.session import cut_lineage


def matching(df: DataFrame, conditions: Sequence[Optional[Column]]) -> DataFrame:
    """Filter by whichever of the optional conditions are given."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """One result page; ``order`` must end in a unique column."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """A page and the number of all rows, from one pass: the rows are counted on their way into the sort.

    The page is written, which runs the pass; at most ``limit`` rows are.
    """
    seen = Observation("page")
    rows = cut_lineage(page(df.observe(seen, F.count(F.lit(1)).alias("total")), order, limit, offset), "page")
    return rows, seen.get["total"]


def page_with_flag(df: DataFrame, order: Sequence[Column], limit: int) -> tuple[DataFrame, DataFrame]:
    """A page, and a one-row frame saying whether rows were left out.

    One row more than asked is read to find out, never the whole input.
    """
    probe = df.orderBy(*order).limit(limit + 1)
    truncated = probe.agg((F.count("*") > limit).alias("truncated"))
    return probe.orderBy(*order).limit(limit), truncated


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def coverage(df: DataFrame, present: Column) -> DataFrame:
    """Totals and the share of rows where ``present`` holds, as a percentage text."""
    total, have = F.count("*"), F.count_if(present)
    return df.agg(
        total.alias("total"),
        have.alias("covered"),
        F.when(total == 0, F.lit("0%"))
        .otherwise(F.concat(F.round(have * 100.0 / total, 1).cast("string"), F.lit("%")))
        .alias("coverage"),
    )


def endpoints(edges: DataFrame) -> DataFrame:
    """Each edge once per endpoint (self loops once): the OR of both columns as a union."""
    ends = F.array_distinct(F.array("subject_uri", "object_uri"))
    return edges.select(F.explode(ends).alias("uri"), "subject_uri", "predicate", "object_uri")


def degree(edges: DataFrame) -> DataFrame:
    return count_by(endpoints(edges), "uri", name="degree")


def enrich(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Names and types of both endpoints, null where the entity is unknown."""
    side = registry.select("uri", "entity_text", "entity_type")
    subject = side.toDF("subject_uri", "subject_name", "subject_type")
    obj = side.toDF("object_uri", "object_name", "object_type")
    return edges.join(subject, "subject_uri", "left").join(obj, "object_uri", "left")


def neighbourhood(edges: DataFrame, registry: DataFrame, uri: Column, predicate: Optional[str] = None) -> DataFrame:
    """Edges touching one entity in either direction, with names."""
    touching = matching(
        edges, [(F.col("subject_uri") == uri) | (F.col("object_uri") == uri),
                F.col("predicate") == predicate if predicate else None]
    )
    return enrich(touching, registry)


def two_hops(first: DataFrame, second: DataFrame) -> DataFrame:
    """Distinct start/end pairs of subject -> x -> object paths with path counts."""
    a = first.select(F.col("subject_uri").alias("start_uri"), F.col("object_uri").alias("via"))
    b = second.select(F.col("subject_uri").alias("via"), F.col("object_uri").alias("end_uri"))
    return a.join(b, "via").groupBy("start_uri", "end_uri").agg(F.count("*").alias("paths"))


def symmetric_closure(edges: DataFrame) -> DataFrame:
    """Adds the reverse of symmetric edges unless it is stored already."""
    mirrored = edges.filter(
        F.col("predicate").isin(fixed.SYMMETRIC_PREDICATES) & (F.col("subject_uri") != F.col("object_uri"))
    ).select(
        F.col("object_uri").alias("subject_uri"), "predicate", F.col("subject_uri").alias("object_uri"),
        F.concat(F.col("source_field"), F.lit("_symmetric")).alias("source_field"), F.lit(1).alias("pass"),
    )
    own = edges.select("subject_uri", "predicate", "object_uri", "source_field", F.lit(0).alias("pass"))
    return (
        own.unionByName(mirrored)
        .groupBy("subject_uri", "predicate", "object_uri")
        .agg(F.min_by("source_field", F.struct("pass", "source_field")).alias("source_field"))
    )


def predicate_table(edges: DataFrame) -> DataFrame:
    """The declared predicates as a DataFrame (27 rows, constant)."""
    spark = edges.sparkSession
    rows = [(p.name, p.field, p.subject_types, p.object_types) for p in fixed.PREDICATES]
    return spark.createDataFrame(
        rows, "predicate string, field string, subject_types array<string>, object_types array<string>"
    )


def type_violations(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """Counts of edges whose endpoint types differ from the declared ones.

    A report only: such edges stay in the graph.
    """
    rules = F.broadcast(predicate_table(edges).drop("field"))
    bad = (F.col("subject_types").isNotNull() & ~F.expr("array_contains(subject_types, subject_type)")) | (
        F.col("object_types").isNotNull() & ~F.expr("array_contains(object_types, object_type)")
    )
    return (
        enrich(edges, registry).join(rules, "predicate", "left")
        .groupBy("predicate", "subject_type", "object_type")
        .agg(F.count("*").alias("edges"), F.count_if(F.coalesce(bad, F.lit(False))).alias("violations"))
    )


def split_valid(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that keep the constraints, and those that do not with a reason."""
    known = [p.name for p in fixed.PREDICATES]
    reason = (
        F.when(F.col("subject_uri").isNull() | F.col("object_uri").isNull(), "missing endpoint")
        .when(F.col("predicate").isNull(), "missing predicate")
        .when(F.col("subject_uri") == F.col("object_uri"), "self loop")
        .when(~F.col("predicate").rlike(fixed.PREDICATE_NAME_PATTERN), "bad predicate name")
        .when(~F.col("predicate").isin(known), "unknown predicate")
    )
    marked = edges.withColumn("reason", reason)
    return marked.filter(F.col("reason").isNull()).drop("reason"), marked.filter(F.col("reason").isNotNull())


def mentioned_in(links: DataFrame, submissions: DataFrame, per_entity: int) -> DataFrame:
    """The first documents of every entity with path, date and source address.

    The row-number filter lets Spark keep only ``per_entity`` rows of a key in
    each map task, so an entity with very many documents is cut before the shuffle.
    """
    order = Window.partitionBy("entity_uri").orderBy("document_rid")
    top = links.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_entity)
    sources = submissions.select(F.concat(F.lit("web:"), F.col("rid")).alias("document_rid"), F.col("url").alias("source_url"))
    path = X.note_path(F.col("document_rid"))
    return top.join(sources, "document_rid", "left").select(
        "entity_uri", "document_rid", F.col("rank").cast("bigint").alias("rank"), "mention_count",
        path.alias("note_path"), X.note_date(path).alias("doc_date"), "source_url",
    )


#: Most items of one packed list; a key with more has several lists.
PACK_ITEMS = 256


def packed(df: DataFrame, key: str, item: str, lists: str) -> DataFrame:
    """(key, lists): the distinct items of each key, sorted, in lists of at most PACK_ITEMS; each item is in one of them.

    Joins that would meet every item of one side with every item of the other
    send one row per list instead. No list grows with the number of items.
    """
    place = F.dense_rank().over(Window.partitionBy(key).orderBy(item))
    ranked = df.filter(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, item, F.floor((place - 1) / PACK_ITEMS).alias("piece"))
    return ranked.groupBy(key, "piece").agg(F.array_sort(F.collect_set(item)).alias(lists)).drop("piece")


def shared_documents(pairs: DataFrame, links: DataFrame, others: Optional[DataFrame] = None) -> DataFrame:
    """Documents naming both sides of each (uri, other_uri) pair, and the score they give.

    ``links`` names the documents of ``uri``, ``others`` those of ``other_uri``
    (``links``, if not given). A document of ``uri`` carries its other entities as
    lists, and those that ``uri`` is listed with are picked from them, so no
    pair becomes a row that is not in the result.
    """
    mine = links.select("document_rid", F.col("entity_uri").alias("uri")).repartition("document_rid").distinct()
    there = packed((links if others is None else others).withColumnRenamed("entity_uri", "other_uri"), "document_rid", "other_uri", "there")
    listed = packed(pairs, "uri", "other_uri", "listed")
    return (
        mine.join(there, "document_rid").select("uri", "there").join(listed, "uri")
        .select("uri", F.explode(F.array_intersect("there", "listed")).alias("other_uri"))
        .groupBy("uri", "other_uri").agg(F.count("*").alias("shared_docs"))
        .withColumn("score", F.round(F.least(F.col("shared_docs") * 0.05, F.lit(0.15)), 4))
    )


def unlinked(registry: DataFrame, links: DataFrame) -> DataFrame:
    """Entities no document mentions."""
    return registry.join(links.select(F.col("entity_uri").alias("uri")), "uri", "left_anti")


def to_notes(uris: DataFrame, mappings: DataFrame) -> DataFrame:
    """Note path and link of each uri; ``found`` is false where none is mapped."""
    one = mappings.groupBy("uri").agg(F.min_by(F.struct("note_path", "name"), "note_path").alias("m"))
    return uris.distinct().join(one, "uri", "left").select(
        "uri", F.col("m.note_path").alias("note_path"), F.col("m.name").alias("name"),
        F.concat(F.lit("[["), F.regexp_replace("m.note_path", r"\.md$", ""), F.lit("]]")).alias("link"),
        F.col("m").isNotNull().alias("found"),
    )


def batch_resolve(targets: DataFrame, registry: DataFrame, links: DataFrame) -> DataFrame:
    """(name, type?) to uri: typed match first, else by name alone.

    By name alone the entity with most mentions wins. Both lookups are one
    aggregation per distinct name, so a repeated name is resolved once.
    """
    keys = targets.select(F.lower("name").alias("normalized_text"), "type_hint").distinct()
    near = registry.join(keys.select("normalized_text").distinct(), "normalized_text", "left_semi")
    of_near = links.join(near.select(F.col("uri").alias("entity_uri")).distinct(), "entity_uri", "left_semi")
    mentions = of_near.groupBy("entity_uri").agg(F.sum("mention_count").alias("total"))
    ranked = near.join(mentions, F.col("uri") == F.col("entity_uri"), "left")
    typed = near.groupBy("normalized_text", F.col("entity_type").alias("type_hint")).agg(F.min("uri").alias("typed_uri"))
    by_name = ranked.groupBy("normalized_text").agg(
        F.min_by("uri", F.struct(-F.coalesce("total", F.lit(0)), F.col("uri"))).alias("name_uri")
    )
    found = keys.join(typed, ["normalized_text", "type_hint"], "left").join(by_name, "normalized_text", "left")
    return found.select(
        F.col("normalized_text").alias("name"), "type_hint",
        F.coalesce("typed_uri", "name_uri").alias("uri"),
        F.when(F.col("typed_uri").isNotNull(), "typed").when(F.col("name_uri").isNotNull(), "name")
        .otherwise("none").alias("matched_by"),
    )


def describe_inputs(registry: DataFrame, edges: DataFrame, per_entity: int = 10) -> DataFrame:
    """Up to ``per_entity`` outgoing relations of every entity as one text each."""
    names = registry.select(F.col("uri").alias("object_uri"), F.col("entity_text").alias("target"))
    order = Window.partitionBy("subject_uri").orderBy("predicate", "object_uri")
    top = edges.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_entity)
    return (
        top.join(names, "object_uri")
        .groupBy(F.col("subject_uri").alias("uri"))
        .agg(F.array_join(F.array_sort(F.collect_list(F.concat("predicate", F.lit(": "), "target"))), "; ").alias("relations"))
    )
