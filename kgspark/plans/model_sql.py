"""The model tables written again as SQL, for the checking queries only."""

from __future__ import annotations


def norm(x: str) -> str:
    return f"ltrim(replace(replace(replace(trim(lower({x})),'_',' '),'-',' '),'  ',' '),'@')"


def uri(name: str, kind: str) -> str:
    n = norm(name)
    return (
        f"('@ENTITY@' || lower({kind}) || '-' || "
        f"left(replace(replace({n},' ','-'),'''',''),50) || '-' || left(sha256({kind} || ':' || {n}),12))"
    )


def authority(url: str) -> str:
    return f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def web_rid(url: str) -> str:
    return f"('orn:web.page:' || translate({authority(url)}, '.:', '__') || '/' || left(sha256({url}),16))"


PERSON = uri("c_name", "'Person'")
ORG = uri("s_name", "'Organization'")
PROJECT_NAME = "(p_name || ' ' || p_partkey)"
PROJECT = uri(PROJECT_NAME, "'Project'")
NATION = uri("n_name", "'Location'")


def _entity(name: str, kind: str, key: str, aliases: str, source: str) -> str:
    return (
        f"SELECT {uri(name, repr(kind))} AS uri, {name} AS entity_text, '{kind}' AS entity_type, "
        f"{norm(name)} AS normalized_text, {aliases} AS aliases, CAST({key} AS BIGINT) AS source_key FROM {source}"
    )


REGISTRY = "registry AS (" + " UNION ALL ".join([
    _entity("c_name", "Person", "c_custkey", "['cust ' || c_custkey]", "customer"),
    _entity("s_name", "Organization", "s_suppkey", "['vendor-' || s_suppkey]", "supplier"),
    _entity(PROJECT_NAME, "Project", "p_partkey", "CAST([] AS VARCHAR[])", "part"),
    _entity("p_name", "Concept", "k", "[split_part(p_name,' ',-1) || ' ' || split_part(p_name,' ',1)]",
            "(SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name)"),
    _entity("n_name", "Location", "n_nationkey", "CAST([] AS VARCHAR[])", "nation"),
    _entity("r_name", "Bioregion", "r_regionkey", "CAST([] AS VARCHAR[])", "region"),
]) + ")"


def _edge(subject: str, predicate: str, obj: str, conf: str, source: str) -> str:
    return (
        f"SELECT {subject} AS subject_uri, '{predicate}' AS predicate, {obj} AS object_uri, "
        f"CAST({conf} AS DOUBLE) AS confidence, 'vault' AS source, 'notes/{predicate}.md' AS source_rid FROM {source}"
    )


_CONF = "round(least(1.0, 0.5 + n * 0.125), 4)"
EDGES = "edges AS (" + " UNION ALL ".join([
    _edge(PERSON, "located_in", NATION, "1.0", "customer JOIN nation ON c_nationkey = n_nationkey"),
    _edge(ORG, "located_in", NATION, "1.0", "supplier JOIN nation ON s_nationkey = n_nationkey"),
    _edge(NATION, "broader", uri("r_name", "'Bioregion'"), "1.0", "nation JOIN region ON n_regionkey = r_regionkey"),
    _edge(ORG, "has_project", PROJECT, _CONF,
          "(SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL) "
          "JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey"),
    _edge(PERSON, "affiliated_with", ORG, _CONF,
          "(SELECT o_custkey, l_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) "
          "JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey"),
]) + ")"

#: The edges worked out once, for queries that ask them several times.
EDGES_ONCE = EDGES.replace("edges AS (", "edges AS MATERIALIZED (", 1)

_ORDER_NOTE = "('vault:notes/Orders/' || strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey || '.md')"
_PART_NOTE = "('vault:Deals/' || l_partkey || '.md')"


def _link(rid: str, entity: str, count: str, source: str) -> str:
    return f"SELECT {rid} AS document_rid, {entity} AS entity_uri, CAST({count} AS BIGINT) AS mention_count FROM {source}"


_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
LINKS = "links AS (" + " UNION ALL ".join([
    _link(_ORDER_NOTE, PERSON, "1", "orders JOIN customer ON o_custkey = c_custkey"),
    _link(_PART_NOTE, PERSON, "n", f"(SELECT l_partkey, o_custkey, count(*) AS n FROM {_LINES} GROUP BY ALL) "
          "JOIN customer ON o_custkey = c_custkey"),
    _link(_ORDER_NOTE, ORG, "n", f"(SELECT o_orderkey, o_orderdate, l_suppkey, count(*) AS n FROM {_LINES} GROUP BY ALL) "
          "JOIN supplier ON l_suppkey = s_suppkey"),
    _link(_PART_NOTE, ORG, "n", "(SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL) "
          "JOIN supplier ON l_suppkey = s_suppkey"),
    _link(_ORDER_NOTE, PROJECT, "n", f"(SELECT o_orderkey, o_orderdate, l_partkey, count(*) AS n FROM {_LINES} GROUP BY ALL) "
          "JOIN part ON l_partkey = p_partkey"),
    _link(f"('web:' || {web_rid('url')})", NATION, "1", "pages JOIN nation ON page_id % 25 = n_nationkey"),
]) + ")"

SUBMISSIONS = (
    f"submissions AS (SELECT page_id, url, {web_rid('url')} AS rid, {authority('url')} AS domain, "
    "'user' || (page_id % 9) AS submitted_by, 'previewed' AS status, "
    "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(page_id * 7 AS INTEGER)) AS created_at, html FROM pages)"
)
MEMORIES = (
    "memories AS (SELECT doc_id, 'vault:' || source || '/doc ' || doc_id || '.md' AS rid, "
    "source AS source_sensor, lang, text FROM documents)"
)
EVENTS = (
    "queue AS (SELECT event_id AS id, CAST(event_id AS VARCHAR) AS event_id, "
    "CASE event_type WHEN 'signup' THEN 'NEW' WHEN 'error' THEN 'FORGET' ELSE 'UPDATE' END AS event_type, "
    "'@NET@' || CASE WHEN user_id % 3 = 0 THEN 'organization' ELSE 'person' END || ':user-' || user_id AS rid, "
    "'@NODE@peer' || (user_id % 4) AS source_node, "
    "CAST(props->>'$.k' AS INTEGER) AS k, user_id, "
    "CASE WHEN CAST(props->>'$.k' AS INTEGER) < 60 THEN printf('Customer#%09d', user_id) ELSE 'Visitor ' || user_id END AS name, "
    "ts AS queued_at, ts + INTERVAL 24 HOUR AS expires_at FROM events)"
)


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts) + " "


MENTIONS = """mentions AS (SELECT 'part-' || p_partkey AS mention_id, CASE p_partkey % 5 WHEN 0 THEN upper(p_name)
WHEN 1 THEN replace(p_name,' ','_') WHEN 2 THEN '[[Concepts/' || split_part(p_name,' ',-1) || ' ' || split_part(p_name,' ',1) || '|x]]'
WHEN 3 THEN left(p_name, CAST(p_partkey % length(p_name) AS INTEGER)) || substr(p_name, p_partkey % length(p_name) + 2)
ELSE p_name END AS name, CASE WHEN p_partkey % 5 <> 4 THEN 'Concept' END AS entity_type FROM part
UNION ALL SELECT 'nation-' || n_nationkey, replace(n_name,'_','-'), 'Location' FROM nation
UNION ALL SELECT 'customer-' || c_custkey, c_name, 'Person' FROM customer
UNION ALL SELECT 'supplier-' || s_suppkey, 'Guild ' || s_suppkey || ' of makers', 'Organization' FROM supplier)"""


def alias(x: str) -> str:
    return f"trim(lower(split_part(regexp_replace({x}, '\\[\\[([^\\]|]+)(?:\\|[^\\]]+)?\\]\\]', '\\1', 'g'), '/', -1)))"


def jaro_winkler(pairs: str) -> str:
    """CTEs that score the relation ``pairs(a, b)`` into ``jw(a, b, score)``; needs RECURSIVE."""
    return f"""
jw_step AS (
 SELECT a, b, 0 AS i, repeat('0', length(b)) AS used, '' AS m1 FROM (SELECT DISTINCT a, b FROM {pairs} WHERE a <> b AND a <> '' AND b <> '')
 UNION ALL
 SELECT a, b, i + 1, CASE WHEN j IS NULL THEN used ELSE left(used, j - 1) || '1' || substr(used, j + 1) END,
  CASE WHEN j IS NULL THEN m1 ELSE m1 || substr(a, i + 1, 1) END
 FROM (SELECT *, CAST(list_min([x for x in range(greatest(1, i + 1 - w), least(length(b), i + 1 + w) + 1)
   if substr(used, x, 1) = '0' AND substr(b, x, 1) = substr(a, i + 1, 1)]) AS INTEGER) AS j
  FROM (SELECT *, greatest(greatest(length(a), length(b)) // 2 - 1, 0) AS w FROM jw_step WHERE i < length(a)))),
jw_match AS (
 SELECT a, b, m1, length(m1) AS m, array_to_string([substr(b, x, 1) for x in range(1, length(b) + 1) if substr(used, x, 1) = '1'], '') AS m2
 FROM jw_step WHERE i = length(a)),
jw_jaro AS (
 SELECT a, b, CASE WHEN m = 0 THEN 0 ELSE (m / length(a) + m / length(b) +
  (m - len([k for k in range(1, m + 1) if substr(m1, k, 1) <> substr(m2, k, 1)]) / 2) / m) / 3 END AS jaro, m FROM jw_match),
jw AS (
 SELECT a, b, CASE WHEN m = 0 THEN 0 ELSE jaro + 0.1 * (1 - jaro) * CASE WHEN left(a,1) <> left(b,1) THEN 0
  WHEN left(a,2) <> left(b,2) OR least(length(a),length(b)) < 2 THEN 1 WHEN left(a,3) <> left(b,3) OR least(length(a),length(b)) < 3 THEN 2
  WHEN left(a,4) <> left(b,4) OR least(length(a),length(b)) < 4 THEN 3 ELSE 4 END END AS score FROM jw_jaro
 UNION ALL SELECT DISTINCT a, b, 1.0 FROM {pairs} WHERE a = b)"""
