"""Entities and relations from extraction results (JSON text), and their ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark import fixed
from kgspark.functions import text as X
from kgspark.operators import similarity_join as J

RESULT = (
    "entities array<struct<name:string,type:string,description:string,fields:map<string,string>,confidence:double>>, "
    "relationships array<struct<subject:string,predicate:string,object:string,confidence:double>>, topics array<string>, summary string"
)


def with_results(docs: DataFrame, extractor, text: str = "text") -> DataFrame:
    """Runs a pluggable extractor (a pandas UDF from text to JSON text) over the documents."""
    return docs.withColumn("result", extractor(F.col(text)))


def parsed(docs: DataFrame, result: str = "result") -> DataFrame:
    return docs.withColumn("r", F.from_json(result, RESULT))


def valid_type(label: Column) -> Column:
    """Known spelling of a type, Concept for anything else."""
    return F.coalesce(X.canonical_type(F.coalesce(label, F.lit("Concept"))), F.lit("Concept"))


def valid_predicate(label: Column) -> Column:
    """Known predicate after dashes and spaces become underscores, null for anything else."""
    known = [p.name for p in fixed.PREDICATES]
    flat = F.lower(F.translate(label, "- ", "__"))
    return F.when(label.isin(known), label).when(flat.isin(known), flat)


def canonical_fields(fields: Column) -> Column:
    """Field names replaced by their canonical synonym; of two that fall together the last stays."""
    table = X.literal_map(fixed.FIELD_SYNONYMS)
    pairs = F.transform(F.map_entries(fields), lambda e: F.struct(F.coalesce(F.element_at(table, F.lower(e["key"])), F.lower(e["key"])).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def entities(docs: DataFrame, keep: list[str]) -> DataFrame:
    each = parsed(docs).select(*keep, F.explode("r.entities").alias("e"))
    return each.select(
        *keep, X.strip(F.coalesce("e.name", F.lit(""))).alias("name"), valid_type(F.col("e.type")).alias("entity_type"),
        X.strip(F.coalesce("e.description", F.lit(""))).alias("description"), canonical_fields(F.col("e.fields")).alias("fields"),
        F.coalesce("e.confidence", F.lit(0.9)).alias("confidence"),
    ).filter("name <> ''")


def relations(docs: DataFrame, keep: list[str]) -> DataFrame:
    each = parsed(docs).select(*keep, F.explode("r.relationships").alias("e"))
    return each.select(
        *keep, X.strip(F.coalesce("e.subject", F.lit(""))).alias("subject"), valid_predicate(F.col("e.predicate")).alias("predicate"),
        X.strip(F.coalesce("e.object", F.lit(""))).alias("object"), F.coalesce("e.confidence", F.lit(0.9)).alias("confidence"),
    ).filter("predicate IS NOT NULL")


def ingest(mentions: DataFrame, registry: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolved mentions, new entities, and the document links after a batch.

    ``mentions`` is (mention_id, document_rid, name, entity_type). New names
    are reduced to one entity per (type, normalized name), so two mentions of a
    new name in one batch become one entity.
    """
    from kgspark.operators import resolve as R
    from kgspark.session import cut_lineage

    done = cut_lineage(R.resolve(mentions.select("mention_id", "name", "entity_type"), registry), "ingest")
    new = done.filter("is_new").groupBy("uri").agg(
        F.min_by(F.struct(F.col("name").alias("entity_text"), F.coalesce("entity_type", F.lit("Concept")).alias("entity_type")), "mention_id").alias("e")
    ).select("uri", "e.*").withColumn("normalized_text", X.normalize_name(F.col("entity_text")))
    batch = done.select("mention_id", "uri").join(mentions.select("mention_id", "document_rid"), "mention_id").groupBy(
        "document_rid", F.col("uri").alias("entity_uri")).agg(F.count("*").alias("mention_count"))
    after = links.select("document_rid", "entity_uri", "mention_count").unionByName(batch).groupBy("document_rid", "entity_uri").agg(
        F.sum("mention_count").alias("mention_count"))
    return done, new, after


def relations_to_edges(found: DataFrame, named: DataFrame, group: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Edges of extracted relations, and pending rows for those with one unknown side.

    ``found`` is (group, subject, predicate, object, confidence) and ``named``
    (group, name, uri, order): the entities of the same extraction, the last of
    which holds a name (lower-cased, without outer spaces). A relation without
    a known side, or of an entity with itself, gives neither. Of repeated
    edges the one of the greatest confidence stays.
    """
    key = lambda c: F.lower(X.strip(F.col(c)))
    names = named.groupBy(F.col(group), key("name").alias("key")).agg(F.max_by("uri", order).alias("uri"))
    side = lambda s: names.select(group, F.col("key").alias(f"{s}_key"), F.col("uri").alias(f"{s}_uri"))
    keyed = found.withColumns({"subject_key": key("subject"), "object_key": key("object")})
    both = keyed.join(side("subject"), [group, "subject_key"], "left").join(side("object"), [group, "object_key"], "left")
    edges = both.filter("subject_uri <> object_uri").groupBy("subject_uri", "predicate", "object_uri").agg(
        F.max("confidence").alias("confidence"), F.max_by(group, F.struct("confidence", group)).alias("source_rid"))
    unknown = F.when(F.col("subject_uri").isNull(), "subject").otherwise("object")
    pending = both.filter("(subject_uri IS NULL) <> (object_uri IS NULL)").select(
        group, "subject_uri", "predicate", "object_uri", unknown.alias("unknown_side"),
        F.when(unknown == "subject", F.col("subject")).otherwise(F.col("object")).alias("raw_unknown_label"), "confidence").distinct()
    return edges, pending


def match_descriptions(wanted: DataFrame, found: DataFrame, source: str, least: float = 80.0) -> DataFrame:
    """Description of each wanted entity from its source's extraction: exact name, else the closest.

    Only names of one source are compared, and of those only pairs that share
    enough characters; a source with very many entities yields no cross product.
    """
    w = wanted.select("uri", F.col(source).alias("grp"), F.lower(X.strip(F.col("entity_text"))).alias("txt"))
    f = found.groupBy(F.col(source).alias("grp"), F.lower(X.strip(F.col("name"))).alias("txt")).agg(F.max("description").alias("description"))
    exact = w.join(f, ["grp", "txt"]).select("uri", F.lit(100.0).alias("ratio"), F.col("txt").alias("name"), "description")
    rest = w.join(exact.select("uri"), "uri", "left_anti")
    close = (
        J.indel_pairs(rest, f, least).join(rest.withColumnRenamed("txt", "left_txt"), ["grp", "left_txt"])
        .join(f.withColumnRenamed("txt", "right_txt"), ["grp", "right_txt"])
    )
    best = close.groupBy("uri").agg(
        F.min_by(F.struct("ratio", F.col("right_txt").alias("name"), "description"), F.struct(-F.col("ratio"), F.col("right_txt"))).alias("m"))
    return exact.unionByName(best.select("uri", "m.ratio", "m.name", "m.description")).filter("description <> ''")
