"""Registered queries: extraction results, ingestion, peers and phonetic matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark import fixed
from kgspark.functions import text as X
from kgspark.functions.phonetic import phonetic_code
from kgspark.operators import extraction as P
from kgspark.operators import federation as N
from kgspark.operators import register as G
from kgspark.operators import resolve as R
from kgspark.operators import sequential as Q
from kgspark.plans import model_sql as M
from kgspark.plans.base import query
from kgspark.sources import tables as T


def _extracted(spark, sf):
    """Extraction results as JSON text, one per supplier, written from the tables."""
    sup = T.table(spark, sf, "supplier").join(T.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.pmod(F.col("s_suppkey"), F.lit(3)) == 0, "ORGANIZATION").when(F.pmod(F.col("s_suppkey"), F.lit(3)) == 1, "Organization").otherwise("Guild")
    text = F.to_json(F.struct(
        F.array(
            F.struct(F.concat(F.lit(" "), "s_name").alias("name"), kind.alias("type"), F.concat(F.lit("Supplier in "), "n_name").alias("description"),
                     F.create_map(F.lit("HQ"), F.col("n_name"), F.lit("Team"), F.lit("many")).alias("fields")),
            F.struct(F.lit(" ").alias("name"), F.lit("Person").alias("type"), F.lit("").alias("description"), F.create_map(F.lit("a"), F.lit("b")).alias("fields")),
        ).alias("entities"),
        F.array(
            F.struct(F.col("s_name").alias("subject"), F.lit("Located-In").alias("predicate"), F.col("n_name").alias("object")),
            F.struct(F.col("s_name").alias("subject"), F.lit("dislikes").alias("predicate"), F.col("n_name").alias("object")),
        ).alias("relationships"),
    ))
    return sup.select("s_suppkey", text.alias("result"))


@query("extracted_entities", """
SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 3 = 2 THEN 'Concept' ELSE 'Organization' END AS entity_type, 'Supplier in ' || n_name AS description,
n_name AS location, 'many' AS people, 0.9 AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def extracted_entities(spark, sf):
    return P.entities(_extracted(spark, sf), ["s_suppkey"]).select(
        "s_suppkey", "name", "entity_type", "description", F.element_at("fields", "location").alias("location"),
        F.element_at("fields", "people").alias("people"), "confidence")


@query("extracted_relations", """
SELECT s_suppkey, s_name AS subject, 'located_in' AS predicate, n_name AS object, 0.9 AS confidence FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def extracted_relations(spark, sf):
    return P.relations(_extracted(spark, sf), ["s_suppkey"])


@query("relation_edges", f"""
WITH rel AS (SELECT s_suppkey, s_name AS subject, n_name AS object FROM supplier JOIN nation ON s_nationkey = n_nationkey),
named AS (SELECT s_suppkey, lower(trim(name)) AS k, uri FROM (
 SELECT s_suppkey, ' ' || upper(s_name) AS name, 'first:' || s_suppkey AS uri, 0 AS n FROM supplier
 UNION ALL SELECT s_suppkey, s_name, {M.uri('s_name', "'Organization'")}, 1 FROM supplier
 UNION ALL SELECT s_suppkey, n_name, {M.uri('n_name', "'Location'")}, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 > 0)
 QUALIFY row_number() OVER (PARTITION BY s_suppkey, lower(trim(name)) ORDER BY n DESC) = 1)
SELECT s.uri AS subject_uri, 'located_in' AS predicate, o.uri AS object_uri, CASE WHEN o.uri IS NULL THEN r.object END AS raw_unknown_label
FROM rel r JOIN named s ON s.s_suppkey = r.s_suppkey AND s.k = lower(r.subject) LEFT JOIN named o ON o.s_suppkey = r.s_suppkey AND o.k = lower(r.object)""")
def relation_edges(spark, sf):
    """Each supplier is named twice (the later name holds); a third of the places were not extracted."""
    sup = T.table(spark, sf, "supplier").join(T.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = lambda text, uri, n: F.struct(text.alias("name"), uri.alias("uri"), F.lit(n).alias("n"))
    entities = [name(F.concat(F.lit(" "), F.upper("s_name")), F.concat(F.lit("first:"), F.col("s_suppkey").cast("string")), 0), name(F.col("s_name"), T.org_uri(), 1)]
    place = F.when(F.pmod("s_suppkey", F.lit(3)) > 0, F.array(name(F.col("n_name"), T.nation_uri(), 2)))
    named = sup.select("s_suppkey", F.explode(F.concat(F.array(*entities), F.coalesce(place, F.array()))).alias("e")).select("s_suppkey", "e.*")
    edges, pending = P.relations_to_edges(P.relations(_extracted(spark, sf), ["s_suppkey"]), named, "s_suppkey", "n")
    return edges.select("subject_uri", "predicate", "object_uri", F.lit(None).cast("string").alias("raw_unknown_label")).unionByName(
        pending.select("subject_uri", "predicate", "object_uri", "raw_unknown_label"))


@query("ingest_links", M.with_(M.REGISTRY, M.LINKS, f"""
m AS (SELECT {M._ORDER_NOTE} AS document_rid, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT document_rid, {M.uri('name', "'Person'")} AS entity_uri, count(*) AS n FROM m GROUP BY ALL
 UNION ALL SELECT document_rid, {M.uri("'Lodge ' || (length(name) + length(document_rid))", "'Organization'")}, count(*) FROM m GROUP BY ALL)""") + """
SELECT document_rid, entity_uri, CAST(sum(n) AS BIGINT) AS mention_count FROM (SELECT document_rid, entity_uri, mention_count AS n FROM links WHERE document_rid LIKE 'vault:notes/Orders/%' UNION ALL SELECT * FROM b)
GROUP BY ALL""")
def ingest_links(spark, sf):
    orders = T.table(spark, sf, "orders").join(T.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = orders.select(F.concat(F.lit("p-"), F.col("o_orderkey").cast("string")).alias("mention_id"), T._order_note().alias("document_rid"),
                        F.col("c_name").alias("name"), F.lit("Person").alias("entity_type"))
    lodge = own.select(F.concat(F.lit("l-"), "mention_id").alias("mention_id"), "document_rid",
                       F.concat(F.lit("Lodge "), (F.length("name") + F.length("document_rid")).cast("string")).alias("name"), F.lit("Organization").alias("entity_type"))
    links = T.document_links(spark, sf).filter(F.col("document_rid").startswith("vault:notes/Orders/"))
    return P.ingest(own.unionByName(lodge), T.entity_registry(spark, sf, ["Person", "Organization"]), links)[2]


_OVERLAP = """(len(string_split({a},' ')) = 1 OR len(string_split({b},' ')) = 1
  OR (len(list_intersect(list_distinct(string_split({a},' ')), list_distinct(string_split({b},' ')))) >= 2
   AND len(list_intersect(list_distinct(string_split({a},' ')), list_distinct(string_split({b},' '))))
    >= 0.5 * least(len(list_distinct(string_split({a},' '))), len(list_distinct(string_split({b},' '))))))"""
_FITS = "{x}.entity_type IS NULL OR {x}.entity_type = {y}"
_BATCH_NUMBER = "CAST(split_part(mention_id, '-', 2) AS BIGINT) * 4 + CASE split_part(mention_id, '-', 1) WHEN 'part' THEN 0 WHEN 'nation' THEN 1 WHEN 'customer' THEN 2 ELSE 3 END"


@query("ingest_sequential", M.with_(M.REGISTRY, M.MENTIONS, f"""
known AS MATERIALIZED (SELECT * FROM registry WHERE entity_type IN ('Person', 'Location')),
keyed AS MATERIALIZED (SELECT mention_id, name, entity_type, {M.norm('name')} AS norm, {M.alias('name')} AS alias, {_BATCH_NUMBER} AS number FROM mentions),
ks AS MATERIALIZED (SELECT *, coalesce(entity_type, 'Concept') AS kind, {M.uri('name', "coalesce(entity_type, 'Concept')")} AS made
 FROM (SELECT norm, alias, entity_type, min(number) AS number, min_by(name, number) AS name FROM keyed GROUP BY ALL)),
surf AS MATERIALIZED (SELECT number, max(strength) AS strength, min_by(uri, {{'a': -strength, 'b': uri}}) AS uri FROM (
 SELECT k.number, 3e0 AS strength, r.uri FROM ks k JOIN known r ON r.normalized_text = k.norm AND ({_FITS.format(x='k', y='r.entity_type')})
 UNION ALL SELECT k.number, 2e0, r.uri FROM ks k JOIN (SELECT uri, entity_type, lower(unnest(aliases)) AS form FROM known) r ON r.form = k.alias AND ({_FITS.format(x='k', y='r.entity_type')})) GROUP BY 1),
unmet AS MATERIALIZED (SELECT * FROM ks WHERE number NOT IN (SELECT number FROM surf)),
pairs AS MATERIALIZED (SELECT DISTINCT o.norm AS a, r.normalized_text AS b FROM unmet o JOIN known r ON {_FITS.format(x='o', y='r.entity_type')}
 UNION SELECT o.norm, k.norm FROM unmet o JOIN unmet k ON {_FITS.format(x='o', y='k.kind')}),
{M.jaro_winkler('pairs')},
near AS MATERIALIZED (SELECT o.number, jw.b, jw.score FROM unmet o JOIN jw ON jw.a = o.norm WHERE jw.score >= CASE o.entity_type WHEN 'Person' THEN 0.92 WHEN 'Organization' THEN 0.85 WHEN 'Location' THEN 0.9 WHEN 'Concept' THEN 0.75 ELSE 0.9 END
 AND (o.entity_type IN ('Person', 'Concept') OR {_OVERLAP.format(a='jw.a', b='jw.b')})),
stored AS MATERIALIZED (SELECT * FROM surf UNION ALL SELECT o.number, max(n.score), min_by(r.uri, {{'a': -n.score, 'b': r.uri}}) FROM unmet o JOIN near n USING (number) JOIN known r ON r.normalized_text = n.b AND ({_FITS.format(x='o', y='r.entity_type')}) GROUP BY 1),
cand AS MATERIALIZED (SELECT * FROM ks WHERE number NOT IN (SELECT number FROM stored)),
met AS MATERIALIZED (SELECT k.number, c.number AS other, 3e0 AS strength FROM ks k JOIN cand c ON c.norm = k.norm AND ({_FITS.format(x='k', y='c.kind')})
 UNION ALL SELECT o.number, c.number, n.score FROM unmet o JOIN near n USING (number) JOIN cand c ON c.norm = n.b AND c.norm <> o.norm AND ({_FITS.format(x='o', y='c.kind')})),
turn AS MATERIALIZED (SELECT number, row_number() OVER (ORDER BY number) AS rn, (SELECT list(other) FROM met WHERE met.number = cand.number AND other < cand.number) AS before FROM cand),
walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS heads UNION ALL
 SELECT t.rn, CASE WHEN list_has_any(heads, coalesce(before, CAST([] AS BIGINT[]))) THEN heads ELSE list_append(heads, t.number) END FROM walk JOIN turn t ON t.rn = walk.rn + 1),
heads AS MATERIALIZED (SELECT unnest(heads) AS number FROM (SELECT heads FROM walk ORDER BY rn DESC LIMIT 1)),
seen AS MATERIALIZED (SELECT number, CAST(-1 AS BIGINT) AS since, strength, uri FROM stored UNION ALL SELECT m.number, m.other, m.strength, c.made FROM met m JOIN heads h ON h.number = m.other JOIN cand c ON c.number = m.other)""", recursive=True) + """
SELECT m.mention_id, coalesce(min_by(s.uri, {'a': -s.strength, 'b': s.uri}), any_value(k.made)) AS uri, count(s.uri) = 0 AS is_new, round(CASE WHEN count(s.uri) = 0 THEN 9e-1 ELSE least(max(s.strength), 1e0) END, 6) AS confidence
FROM keyed m JOIN ks k ON k.norm = m.norm AND k.alias = m.alias AND k.entity_type IS NOT DISTINCT FROM m.entity_type LEFT JOIN seen s ON s.number = k.number AND s.since < m.number GROUP BY 1""")
def ingest_sequential(spark, sf):
    part = F.split("mention_id", "-")
    place = F.when(part[0] == "part", 0).when(part[0] == "nation", 1).when(part[0] == "customer", 2).otherwise(3)
    batch = T.mentions(spark, sf).withColumn("document_rid", F.lit("batch")).withColumn("number", part[1].cast("bigint") * 4 + place)
    links = spark.createDataFrame([], "document_rid string, entity_uri string, mention_count long")
    done = Q.ingest_in_order(batch, T.entity_registry(spark, sf, ["Person", "Location"]), links, "number")[0]
    return done.select("mention_id", "uri", "is_new", "confidence")


_RID = """'@NET@' || lower(kind) || ':' || trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(norm)),'[^\\p{L}\\p{N}_\\s-]','','g'),'[\\s_]+','-','g'),'-+','-','g'),'-') || '+' || left(sha256(uri),16)"""


@query("register_entities", f"""
WITH b AS (SELECT 'vault:People/' || c_custkey AS vault_rid, c_name AS name, 'Person' AS kind, c_custkey * 3 AS n, ['C ' || c_custkey, 'cust ' || c_custkey] AS more FROM customer
 UNION ALL SELECT 'vault:Organizations/' || s_suppkey, 'Lodge ' || left(sha256(CAST(s_suppkey AS VARCHAR)), 12), 'Organization', s_suppkey * 3 + 1, CAST([] AS VARCHAR[]) FROM supplier
 UNION ALL SELECT 'vault:Organizations/again-' || s_suppkey, 'LODGE ' || left(sha256(CAST(s_suppkey AS VARCHAR)), 12), 'Organization', 1000000000 + s_suppkey * 3 + 2, ['L' || s_suppkey] FROM supplier),
u AS (SELECT *, {M.norm('name')} AS norm, {M.uri('name', 'kind')} AS uri FROM b)
SELECT vault_rid, uri AS canonical_uri, CASE WHEN vault_rid LIKE 'vault:Organizations/%' AND vault_rid NOT LIKE '%again%' THEN 'NEW' ELSE 'UPDATE' END AS event_type, {_RID} AS rid,
 CASE kind WHEN 'Person' THEN array_to_string(list_sort(list_distinct(['c ' || split_part(vault_rid, '/', 2), 'cust ' || split_part(vault_rid, '/', 2)])), ',') ELSE 'l' || regexp_extract(vault_rid, '(\\d+)$', 1) END AS aliases,
 CASE kind WHEN 'Person' THEN vault_rid ELSE replace(vault_rid, 'again-', '') END AS first_rid FROM u""")
def register_entities(spark, sf):
    """Notes of known people, of unknown organizations, and of the same organizations again."""
    t = lambda n: T.table(spark, sf, n)
    text = lambda c: F.col(c).cast("string")

    def notes(df, rid, name, kind, number, aliases):
        return df.select(rid.alias("vault_rid"), F.concat(rid, F.lit(".md")).alias("vault_path"), name.alias("name"), F.lit(kind).alias("entity_type"), F.sha2(name, 256).alias("content_hash"),
                         aliases.cast("array<string>").alias("aliases"), number.alias("number"))

    hashed = F.substring(F.sha2(text("s_suppkey"), 256), 1, 12)
    place = lambda kind, c: F.concat(F.lit(f"vault:{kind}"), text(c))
    people = notes(t("customer"), place("People/", "c_custkey"), F.col("c_name"), "Person", F.col("c_custkey") * 3,
                   F.array(F.concat(F.lit("[[People/C "), text("c_custkey"), F.lit("]]")), F.concat(F.lit("Cust "), text("c_custkey"))))
    lodges = notes(t("supplier"), place("Organizations/", "s_suppkey"), F.concat(F.lit("Lodge "), hashed), "Organization", F.col("s_suppkey") * 3 + 1, F.array())
    again = notes(t("supplier"), place("Organizations/again-", "s_suppkey"), F.concat(F.lit("LODGE "), hashed), "Organization", F.col("s_suppkey") * 3 + 1_000_000_002,
                  F.array(F.concat(F.lit("L"), text("s_suppkey"))))
    registry = T.entity_registry(spark, sf, ["Person"]).withColumns({"vault_rid": F.lit(None).cast("string"), "koi_rid": F.lit(None).cast("string")})
    batch = people.unionByName(lodges).unionByName(again)
    empty = lambda schema: spark.createDataFrame([], schema)
    done = G.register(batch, registry, empty("vault_rid string, vault_path string, canonical_uri string, entity_type string, name string, content_hash string, sync_status string"),
                      empty("pending_id long, subject_uri string, predicate string, object_uri string, raw_unknown_label string, unknown_side string, target_type_hint string, source_field string"), "number")
    entity = done.registry.select(F.col("uri").alias("canonical_uri"), F.array_join("aliases", ",").alias("aliases"), F.col("vault_rid").alias("first_rid"))
    told = done.events.join(batch.select("number", "vault_rid"), "number").select("vault_rid", "event_type", "rid")
    return done.mappings.select("vault_rid", "canonical_uri").join(told, "vault_rid").join(entity, "canonical_uri")


@query("enrich_match", """
SELECT 'org:' || s_suppkey AS uri, CASE WHEN s_suppkey % 2 = 0 THEN 100.0 ELSE round(200.0 * 17 / (18 + 17), 6) END AS ratio, 'Supplier in ' || n_name AS description
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def enrich_match(spark, sf):
    found = P.entities(_extracted(spark, sf), ["s_suppkey"])
    # Half of the stored names lost a letter.
    name = F.when(F.pmod(F.col("s_suppkey"), F.lit(2)) == 0, F.col("s_name")).otherwise(F.replace("s_name", F.lit("pp"), F.lit("p")))
    wanted = T.table(spark, sf, "supplier").select(F.concat(F.lit("org:"), F.col("s_suppkey").cast("string")).alias("uri"), name.alias("entity_text"), "s_suppkey")
    return P.match_descriptions(wanted, found, "s_suppkey").select("uri", F.round("ratio", 6).alias("ratio"), "description")


@query("poll_plan", """
SELECT '@NODE@peer' || n_nationkey AS source_node, n_name AS node_name, 'https://n' || n_nationkey || '.example.org' AS base_url,
CASE WHEN n_nationkey % 4 = 0 THEN 0.0 ELSE 30.0 * pow(2, n_nationkey % 4 - 1) END AS wait_seconds FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 6 <= 3""")
def poll_plan(spark, sf):
    nation = T.table(spark, sf, "nation")
    key = F.col("n_nationkey")
    rid = F.concat(F.lit(fixed.NODE_RID_PREFIX + "peer"), key.cast("string"))
    nodes = nation.select(rid.alias("node_rid"), F.col("n_name").alias("node_name"), F.concat(F.lit("https://n"), key.cast("string"), F.lit(".example.org")).alias("base_url"))
    edges = nation.select(rid.alias("source_node"), F.lit("self").alias("target_node"), F.when(key % 2 == 0, "POLL").otherwise("WEBHOOK").alias("edge_type"), F.lit("APPROVED").alias("status"))
    failures = nation.select(rid.alias("peer"), F.when(key % 6 > 3, 9).otherwise(key % 4).cast("int").alias("failures"))
    return N.due_peers(N.poll_plan(edges, nodes, "self"), failures).select("source_node", "node_name", "base_url", "wait_seconds")


@query("bootstrap_keys", """
SELECT '@NODE@n' || c_custkey || '+' || left(sha256(to_base64(encode('key ' || c_custkey))), 16) AS source_node, to_base64(encode('key ' || c_custkey)) AS public_key FROM customer WHERE c_custkey % 3 <> 0""")
def bootstrap_keys(spark, sf):
    cust = T.table(spark, sf, "customer")
    k = F.col("c_custkey").cast("string")
    key = F.base64(F.encode(F.concat(F.lit("key "), k), "UTF-8"))
    rid = N.node_rid(F.concat(F.lit("n"), k), key, "legacy16")
    # A third of the senders announce a key that is not theirs.
    said = F.when(F.pmod(F.col("c_custkey"), F.lit(3)) == 0, F.base64(F.encode(F.lit("forged"), "UTF-8"))).otherwise(key)
    event = lambda kind, c: F.struct(F.lit(kind).alias("event_type"), rid.alias("rid"), c.alias("contents"))
    payloads = cust.select(rid.alias("source_node"), F.array(event("FORGET", F.lit(None).cast("string")), event("NEW", F.to_json(F.struct(said.alias("public_key"))))).alias("events"))
    return N.bootstrap_keys(payloads)


@query("phonetic_names")
def phonetic_names(spark, sf):
    first = X.significant_token(X.normalize_name(F.col("entity_text")), fixed.GLOBAL_STOPWORDS + fixed.TYPE_STOPWORDS["Person"])
    tokens = T.entity_registry(spark, sf).select(first.alias("token")).groupBy("token").agg(F.count("*").alias("entities"))
    return tokens.withColumn("code", phonetic_code(F.col("token")))


@query("contextual_people", M.with_(M.REGISTRY, M.LINKS, """
ends AS (SELECT l_suppkey, min(o_custkey) AS lo, max(o_custkey) AS hi FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
ctx AS (SELECT l_suppkey AS mention_id, lower(replace(printf('Customer#%09d', lo), 'o', '')) AS norm, printf('Customer#%09d', hi) AS person FROM ends),
docs AS (SELECT DISTINCT c.mention_id, c.norm, l.document_rid FROM ctx c JOIN registry r ON r.entity_type = 'Person' AND r.entity_text = c.person JOIN links l ON l.entity_uri = r.uri),
cands AS (SELECT d.mention_id, d.norm, r.uri, r.normalized_text, count(*) AS doc_count FROM docs d JOIN links l USING (document_rid)
 JOIN registry r ON r.uri = l.entity_uri AND r.entity_type = 'Person' GROUP BY ALL),
cpairs AS (SELECT DISTINCT norm AS a, normalized_text AS b FROM cands)""", M.jaro_winkler("cpairs"), recursive=True) + """
SELECT * FROM (SELECT mention_id, uri, doc_count, round(0.5 * score + 0.2 + 0.3 * least(doc_count / 3.0, 1.0), 6) AS score,
CAST(row_number() OVER (PARTITION BY mention_id ORDER BY round(0.5 * score + 0.2 + 0.3 * least(doc_count / 3.0, 1.0), 6) DESC, uri) AS INTEGER) AS rank
FROM cands JOIN jw ON jw.a = norm AND jw.b = normalized_text WHERE score >= 0.4) WHERE rank <= 10""")
def contextual_people(spark, sf):
    """Person mentions with a letter lost, next to one known person; the codes of both spellings agree."""
    lines = T.table(spark, sf, "lineitem").join(T.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    person = lambda c: F.format_string("Customer#%09d", F.col(c))
    mentions = lines.groupBy("l_suppkey").agg(F.min("o_custkey").alias("lo"), F.max("o_custkey").alias("hi")).select(
        F.col("l_suppkey").alias("mention_id"), F.replace(person("lo"), F.lit("o"), F.lit("")).alias("name"), F.lit("Person").alias("entity_type"), F.array(person("hi")).alias("people"))
    registry = T.numbered_registry(spark, sf, ["Person"])
    links = T.document_links(spark, sf, ["Person"], ids=True).withColumn("entity_type", F.lit("Person"))
    people = R.context_people(mentions, registry.withColumn("uri", F.col("id")))
    docs = R.candidate_documents(people, links, mentions.select("mention_id", "entity_type")).withColumnRenamed("uri", "id")
    stop = fixed.GLOBAL_STOPWORDS + fixed.TYPE_STOPWORDS["Person"]
    known = registry.select("id", "uri", F.col("entity_text").alias("candidate_name"), F.col("normalized_text").alias("candidate_norm"),
                            phonetic_code(X.significant_token(F.col("normalized_text"), stop)).alias("candidate_code"))
    norm = X.normalize_name(F.col("name"))
    asked = mentions.select("mention_id", "entity_type", norm.alias("norm"), phonetic_code(X.significant_token(norm, stop)).alias("code"))
    cands = docs.join(known, "id").join(asked, "mention_id").withColumn("phonetic_match", F.coalesce(F.col("code") == F.col("candidate_code"), F.lit(False)))
    scored = R.score_candidates(cands.withColumn("relevance", F.lit(None).cast("double")))
    return R.best_ten(scored).select("mention_id", "uri", "doc_count", "score", "rank")
