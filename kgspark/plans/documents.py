"""Registered queries: identifiers, chunks and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgspark import fixed
from kgspark.functions import text as X
from kgspark.operators import documents as D
from kgspark.operators import graph as G
from kgspark.plans import model_sql as M
from kgspark.plans.base import query
from kgspark.sources import tables as T

# White space for RE2, the same set the Spark side splits on.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_TOKENS = f"list_filter(regexp_split_to_array(text, '{_WS}+'), lambda t: t <> '')"
_STRIP = f"regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g')"


@query("entity_uri", M.with_(M.REGISTRY) + "SELECT source_key, entity_type, uri FROM registry")
def entity_uri(spark, sf):
    return T.entity_registry(spark, sf).select("source_key", "entity_type", "uri")


@query("web_rid", f"""
SELECT page_id, {M.web_rid('url')} AS rid, {M.authority('url')} AS domain, left(sha256(url), 12) AS monitor_rid,
sha256(html) AS content_hash, left(sha256(html), 16) AS short_hash FROM pages""")
def web_rid(spark, sf):
    url = F.col("url")
    return T.table(spark, sf, "pages").select(
        "page_id", X.web_rid(url).alias("rid"), X.url_authority(url).alias("domain"), X.monitor_rid(url).alias("monitor_rid"),
        F.sha2("html", 256).alias("content_hash"), F.substring(F.sha2("html", 256), 1, 16).alias("short_hash"),
    )


@query("rid_type", M.with_(M.EVENTS) + """
SELECT raw AS rid_type, canonical, count(*) AS n FROM (SELECT CASE WHEN user_id % 3 = 0 THEN 'Organization' ELSE 'Person' END AS raw,
CASE WHEN user_id % 3 = 0 THEN 'Organization' ELSE 'Person' END AS canonical FROM queue) GROUP BY ALL""")
def rid_type(spark, sf):
    kind = X.rid_type(F.col("rid"))
    return T.network_events(spark, sf).groupBy(kind.alias("rid_type"), X.canonical_type(kind).alias("canonical")).agg(F.count("*").alias("n"))


@query("wikilink_parse", """
WITH l AS (SELECT n_nationkey, '"[[Places/' || replace(n_name,'_','-') || '|n]]"' AS link, 'Location' AS t FROM nation
UNION ALL SELECT p_partkey, 'concepts/' || replace(p_name,' ','-'), 'Concept' FROM part
UNION ALL SELECT c_custkey, c_name, NULL FROM customer)
SELECT n_nationkey AS id, link, CASE WHEN t = 'Location' THEN regexp_replace(regexp_extract(link,'/([^|]+)',1),'-',' ','g')
WHEN t = 'Concept' THEN replace(split_part(link,'/',2),'-',' ') ELSE link END AS name, t AS type_hint FROM l""")
def wikilink_parse(spark, sf):
    t = lambda n: T.table(spark, sf, n)
    links = (
        t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit('"[[Places/'), F.replace("n_name", F.lit("_"), F.lit("-")), F.lit('|n]]"')).alias("link"))
        .unionByName(t("part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("concepts/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("link")))
        .unionByName(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("link")))
    )
    return links.select("id", "link", X.link_name(F.col("link")).alias("name"), X.link_type(F.col("link")).alias("type_hint"))


@query("note_path_date", M.with_(M.LINKS) + """
SELECT doc_date, count(DISTINCT document_rid) AS documents FROM (SELECT document_rid,
nullif(regexp_extract(document_rid, '/(\\d{4}-\\d{2}-\\d{2})[^/]*$', 1), '') AS doc_date FROM links) GROUP BY doc_date""")
def note_path_date(spark, sf):
    docs = T.document_links(spark, sf, ids=True).select("document_rid.*").distinct()
    rid = T.document_rid(F.struct("day", "key", "web"))
    return docs.groupBy(X.note_date(X.note_path(rid)).alias("doc_date")).agg(F.count("*").alias("documents"))


@query("search_hit_slug", M.with_(M.MEMORIES) + """
SELECT doc_id, rid, source_sensor || '/doc-' || doc_id AS site_path, lower(source_sensor) || '/' || 'doc-' || doc_id AS page FROM memories""")
def search_hit_slug(spark, sf):
    return T.memories(spark, sf).select(
        "doc_id", "rid", X.hit_slug(F.col("rid")).alias("site_path"),
        X.page_slug(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), F.lower("source_sensor")).alias("page"),
    )


@query("word_counts", f"""
SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS words, len({_TOKENS}) < 50 AS sparse, left(sha256(text), 32) AS hash32 FROM documents""")
def word_counts(spark, sf):
    n = X.word_count(F.col("text"))
    return T.table(spark, sf, "documents").select(
        "doc_id", n.alias("words"), (n < fixed.SPARSE_PAGE_WORDS).alias("sparse"), F.substring(F.sha2("text", 256), 1, 32).alias("hash32"))


@query("fixed_chunks", f"""
WITH t AS (SELECT doc_id, {_TOKENS} AS toks, {_STRIP} AS whole FROM documents),
b AS (SELECT doc_id, toks, whole, len(toks) AS n, unnest(range(0, CAST(greatest(ceil((len(toks) - 500) / 450.0), 0) AS BIGINT) + 1)) AS i FROM t WHERE len(toks) > 0),
c AS (SELECT doc_id, i * 450 AS s, least(i * 450 + 500, n) AS e, n, CASE WHEN n <= 500 THEN whole ELSE array_to_string(toks[i * 450 + 1 : i * 450 + 500], ' ') END AS text FROM b)
SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks,
CAST(s AS INTEGER) AS start_token, CAST(e AS INTEGER) AS end_token, sha256(text) AS text_hash FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY s)""")
def fixed_chunks(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "text")
    return D.fixed_chunks(docs, ["doc_id"]).withColumn("text_hash", F.sha2("text", 256)).drop("text")


@query("sentence_chunks", f"""
WITH RECURSIVE t AS (SELECT doc_id, {_TOKENS} AS toks, {_STRIP} AS whole FROM documents),
stops AS (SELECT doc_id, [i for i in range(1, len(toks) + 1) if regexp_matches(toks[i], '[.!?]$')] AS stops, len(toks) AS n FROM t),
walk AS (SELECT doc_id, n, stops, CAST(0 AS BIGINT) AS s, CAST(CASE WHEN n <= 500 THEN n ELSE coalesce(list_max([p for p in stops if p <= 500 AND p > 400]), 500) END AS BIGINT) AS e FROM stops WHERE n > 0
 UNION ALL SELECT doc_id, n, stops, s, CAST(coalesce(list_max([p for p in stops if p <= least(s + 500, n) AND p > greatest(s, least(s + 500, n) - 100)]), least(s + 500, n)) AS BIGINT) AS e
 FROM (SELECT doc_id, n, stops, greatest(e - 50, s + 1) AS s FROM walk WHERE n > 500) WHERE s < n),
long AS (SELECT doc_id, n, s, e FROM walk WHERE s = 0 OR e - s >= 100),
kept AS (SELECT * FROM long UNION ALL SELECT doc_id, n, max(e) AS s, n AS e FROM long GROUP BY doc_id, n HAVING max(e) < n)
SELECT k.doc_id, CAST(row_number() OVER (PARTITION BY k.doc_id ORDER BY s) - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY k.doc_id) AS INTEGER) AS total_chunks,
CAST(s AS INTEGER) AS start_token, CAST(e AS INTEGER) AS end_token,
sha256(CASE WHEN n <= 500 THEN whole ELSE array_to_string(toks[s + 1 : e], ' ') END) AS text_hash FROM kept k JOIN t ON t.doc_id = k.doc_id""")
def sentence_chunks(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "text")
    return D.sentence_chunks(docs, ["doc_id"]).withColumn("text_hash", F.sha2("text", 256)).drop("text")


@query("embed_text", f"""
SELECT doc_id, sha256(source || chr(10) || array_to_string({_TOKENS}, ' ')) AS text_hash,
 sha256(left(source || chr(10) || array_to_string({_TOKENS}[1:500], ' '), 2000)) AS short_hash FROM documents""")
def embed_text(spark, sf):
    source, text = F.col("source"), F.col("text")
    return T.table(spark, sf, "documents").select(
        "doc_id", F.sha2(D.embed_text(source, text), 256).alias("text_hash"), F.sha2(D.embed_text(source, text, 500, 2000), 256).alias("short_hash"))


@query("text_search_ilike", M.with_(M.MEMORIES) + """
SELECT rid, source_sensor, left(text, 500) AS content_preview, source_sensor || '/doc-' || doc_id AS site_path FROM memories WHERE text ILIKE '%THE re%'
ORDER BY doc_id DESC, rid LIMIT 20""")
def text_search_ilike(spark, sf):
    return D.text_search(T.memories(spark, sf), "THE re", 20, F.desc("doc_id"))


@query("chunk_search", f"""
WITH t AS (SELECT doc_id, source, {_TOKENS} AS toks, {_STRIP} AS whole FROM documents),
b AS (SELECT *, len(toks) AS n, unnest(range(0, CAST(greatest(ceil((len(toks) - 500) / 450.0), 0) AS BIGINT) + 1)) AS i FROM t WHERE len(toks) > 0),
c AS (SELECT doc_id, source, i * 450 AS s, least(i * 450 + 500, n) AS e, CASE WHEN n <= 500 THEN whole ELSE array_to_string(toks[i * 450 + 1 : i * 450 + 500], ' ') END AS text FROM b)
SELECT doc_id, source, CAST(s AS INTEGER) AS start_token, left(text, 500) AS content_preview FROM c WHERE text ILIKE '%ing the%'
ORDER BY doc_id DESC, s LIMIT 25""")
def chunk_search(spark, sf):
    docs = T.table(spark, sf, "documents").select("doc_id", "source", "text")
    chunks = D.fixed_chunks(docs, ["doc_id", "source"])
    return (
        chunks.filter(F.col("text").ilike("%ing the%")).orderBy(F.desc("doc_id"), "start_token").limit(25)
        .select("doc_id", "source", "start_token", F.substring("text", 1, 500).alias("content_preview"))
    )


_COS = """list_dot_product(CAST(embedding AS DOUBLE[]), q) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) * list_dot_product(q, q))"""


@query("cosine_topk", f"""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7)
SELECT vec_id, label, round({_COS}, 6) AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id, label LIMIT 20""")
def cosine_topk(spark, sf):
    vecs = T.table(spark, sf, "embeddings")
    q = vecs.filter("vec_id = 7").select("embedding").first()[0]  # the query vector: one row
    return D.nearest(vecs.select("vec_id", "label", F.col("embedding").alias("vec")), q, 20, ["vec_id", "label"])


@query("document_vector_search", f"""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3)
SELECT doc_id, source, similarity FROM (SELECT doc_id, source, round({_COS}, 6) AS similarity
FROM documents JOIN embeddings ON doc_id = vec_id, q ORDER BY similarity DESC, doc_id, source LIMIT 50) WHERE similarity >= 0.1""")
def document_vector_search(spark, sf):
    vecs = T.table(spark, sf, "embeddings")
    q = vecs.filter("vec_id = 3").select("embedding").first()[0]
    docs = T.table(spark, sf, "documents").select("doc_id", "source")
    joined = docs.join(vecs.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), "doc_id")
    return D.nearest(joined, q, 50, ["doc_id", "source"], at_least=0.1)


@query("knowledge_search", f"""
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3),
m AS (SELECT doc_id, source || '/' || doc_id AS rid, source AS title, text, ['email-sensor', 'obsidian-sensor', 'github-sensor'][CAST(doc_id % 3 + 1 AS INTEGER)] AS source_sensor FROM documents),
mail AS (SELECT conv_id AS doc_id, left(text, 40) AS subject, role AS from_name FROM conversations WHERE turn = 0),
d AS (SELECT 'document' AS hit, rid, rid AS document_rid, title, left(text, 500) AS preview, round({_COS}, 6) AS similarity, doc_id FROM m JOIN embeddings ON vec_id = doc_id, q WHERE source_sensor = 'email-sensor' ORDER BY similarity DESC, rid LIMIT 15),
c AS (SELECT 'chunk' AS hit, 'chunk:' || vec_id AS rid, rid AS document_rid, title, left(substr(text, 11), 500) AS preview, round({_COS}, 6) AS similarity, doc_id
 FROM m JOIN embeddings ON vec_id // 2 = doc_id, q WHERE source_sensor = 'email-sensor' ORDER BY similarity DESC, 'chunk:' || vec_id, rid LIMIT 15)
SELECT hit, h.rid, document_rid, title, preview, similarity, subject, from_name FROM (SELECT * FROM d UNION ALL SELECT * FROM c) h LEFT JOIN mail USING (doc_id)""")
def knowledge_search(spark, sf):
    """Two chunks for each document that has a vector; mail heads are the first turns of conversations."""
    vecs = T.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    q = vecs.filter("vec_id = 3").select("vec").first()[0]  # the query vector: one row
    sensors = F.array(*map(F.lit, ["email-sensor", "obsidian-sensor", "github-sensor"]))
    rid = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    docs = T.table(spark, sf, "documents").select("doc_id", rid.alias("rid"), F.col("source").alias("title"), "text", F.get(sensors, F.pmod("doc_id", F.lit(3))).alias("source_sensor"))
    memories = docs.join(vecs, F.col("doc_id") == F.col("vec_id"), "left").drop("vec_id")
    owner = docs.select(F.col("doc_id"), F.col("rid").alias("document_rid"), F.expr("substr(text, 11)").alias("text"))
    chunks = vecs.withColumn("doc_id", F.floor(F.col("vec_id") / 2)).join(owner, "doc_id").select(F.concat(F.lit("chunk:"), F.col("vec_id").cast("string")).alias("chunk_rid"), "document_rid", "text", "vec")
    none = F.lit(None).cast("string")
    mail = T.table(spark, sf, "conversations").filter("turn = 0").join(docs.select("doc_id", "rid"), F.col("conv_id") == F.col("doc_id")).select(
        "rid", F.substring("text", 1, 40).alias("subject"), F.col("role").alias("from_name"), none.alias("from_address"), none.alias("date_sent"))
    return D.knowledge_search(memories, chunks, q, 15, "email", mail).select("hit", "rid", "document_rid", "title", "preview", "similarity", "subject", "from_name")


_GRAMS = "list_distinct(flatten([[substr('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in string_split(trim(regexp_replace(lower({x}),'[^\\p{{L}}\\p{{N}}]+',' ','g')),' ') if w <> '']))"


@query("trigram_search", M.with_(M.REGISTRY, M.EDGES, f"""
g AS (SELECT uri, entity_text, entity_type, {_GRAMS.format(x='entity_text')} AS a, {_GRAMS.format(x="'red widgt 12'")} AS b FROM registry),
hits AS (SELECT uri, entity_text, entity_type, round(len(list_intersect(a,b)) / (len(a) + len(b) - len(list_intersect(a,b))), 6) AS similarity FROM g),
top AS (SELECT * FROM hits WHERE similarity > 0.2 ORDER BY similarity DESC, uri LIMIT 20),
deg AS (SELECT uri, count(*) AS degree FROM (SELECT subject_uri AS uri FROM edges UNION ALL SELECT object_uri FROM edges) GROUP BY uri)""") + """
SELECT t.*, CASE WHEN row_number() OVER (ORDER BY similarity DESC, t.uri) <= 5 THEN coalesce(degree, 0) ELSE 0 END AS degree FROM top t LEFT JOIN deg ON deg.uri = t.uri""")
def trigram_search(spark, sf):
    hits = D.trigram_search(T.entity_registry(spark, sf), "red widgt 12", 20).select("uri", "entity_text", "entity_type", "similarity")
    return D.entity_hits(hits, G.degree(T.relationships(spark, sf))).withColumn("degree", F.coalesce("degree", F.lit(0)))


@query("session_search", """
WITH log AS (SELECT conv_id, TIMESTAMP '2024-01-01' + to_hours(CAST(conv_id AS INTEGER)) AS started FROM conversations WHERE role = 'system' GROUP BY conv_id)
SELECT session_id, chunk_index, role, started, preview FROM (SELECT c.conv_id AS session_id, c.turn AS chunk_index, c.role,
strftime(started, '%Y-%m-%d %H:%M:%S') AS started, left(c.text, 200) AS preview FROM conversations c LEFT JOIN log USING (conv_id)
WHERE c.text ILIKE '%the%' ORDER BY log.started DESC NULLS FIRST, c.conv_id, c.turn LIMIT 40)""")
def session_search(spark, sf):
    turns = T.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("chunk_index"), "role", "text")
    log = turns.filter("role = 'system'").select("session_id").distinct().withColumn(
        "started", F.date_format(F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("session_id").cast("int")), "yyyy-MM-dd HH:mm:ss"))
    return D.session_search(turns, log, "the", 40)


@query("session_stats", f"""
SELECT role, count(*) AS chunks, count(DISTINCT conv_id) AS sessions, CAST(sum(len({_TOKENS})) AS BIGINT) AS words,
max(turn) AS last_turn FROM conversations GROUP BY role""")
def session_stats(spark, sf):
    return T.table(spark, sf, "conversations").groupBy("role").agg(
        F.count("*").alias("chunks"), F.countDistinct("conv_id").alias("sessions"),
        F.sum(X.word_count(F.col("text"))).alias("words"), F.max("turn").alias("last_turn"))


@query("array_exists_filter", """
WITH f AS (SELECT conv_id, turn, string_split(text, chr(10)) AS files FROM conversations)
SELECT conv_id, turn, CAST(len(files) AS INTEGER) AS n_files FROM f
WHERE len(list_filter(files, lambda x: x ILIKE '%tion the%')) > 0 AND len(files) > 0""")
def array_exists_filter(spark, sf):
    files = F.split("text", "\n")
    return (
        T.table(spark, sf, "conversations").select("conv_id", "turn", files.alias("files"))
        .filter(F.exists("files", lambda x: x.ilike("%tion the%")) & (F.size("files") > 0))
        .select("conv_id", "turn", F.nullif(F.size("files"), F.lit(0)).alias("n_files"))
    )


@query("file_usage", """
SELECT word, count(*) AS uses, count(DISTINCT conv_id) AS sessions FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS word FROM conversations)
WHERE word <> '' GROUP BY word""")
def file_usage(spark, sf):
    rows = T.table(spark, sf, "conversations").select("conv_id", F.explode(F.split("text", "\n")).alias("word")).filter("word <> ''")
    return rows.groupBy("word").agg(F.count("*").alias("uses"), F.countDistinct("conv_id").alias("sessions"))


@query("json_field_extract", """
SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, props->>'$.missing' AS missing FROM events""")
def json_field_extract(spark, sf):
    return T.table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("related_documents", M.with_(M.LINKS, M.EDGES, f"""
hub AS (SELECT {M.uri("'Supplier#000000003'", "'Organization'")} AS uri),
asked AS (SELECT 'project' AS strategy, object_uri AS entity_uri FROM edges, hub WHERE predicate = 'has_project' AND subject_uri = uri
UNION ALL SELECT 'attendees', subject_uri FROM edges, hub WHERE predicate = 'affiliated_with' AND object_uri = uri AND confidence >= 0.875),
found AS (SELECT strategy, document_rid FROM links JOIN asked USING (entity_uri)
UNION ALL SELECT 'topics', document_rid FROM links WHERE lower(document_rid) LIKE '%2024-01%')""") + """
SELECT document_rid, string_agg(DISTINCT strategy, ',' ORDER BY strategy) AS strategies FROM found GROUP BY document_rid""")
def related_documents(spark, sf):
    hub = X.entity_uri(F.lit("Supplier#000000003"), F.lit("Organization"))
    links = T.document_links(spark, sf)
    projects = T.relationships(spark, sf, ["has_project"]).filter(F.col("subject_uri") == hub)
    people = T.relationships(spark, sf, ["affiliated_with"]).filter((F.col("object_uri") == hub) & (F.col("confidence") >= 0.875))
    asked = projects.select(F.lit("project").alias("strategy"), F.col("object_uri").alias("entity_uri")).unionByName(
        people.select(F.lit("attendees").alias("strategy"), F.col("subject_uri").alias("entity_uri")))
    topics = links.filter(F.lower("document_rid").contains("2024-01")).select(F.lit("topics").alias("strategy"), "document_rid")
    return D.related_documents(asked, links, topics)
