"""Registered queries: constraints, transactions and the bulk graph sink."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.operators import constraints as C
from kgspark.operators import store as S
from kgspark.operators import transaction as X
from kgspark.plans import model_sql as M
from kgspark.plans.base import query
from kgspark.session import run_dir
from kgspark.sources import graph_store as G
from kgspark.sources import tables as T


@query("constraint_split", """
WITH n AS (SELECT *, CASE WHEN n_regionkey = 3 THEN 'check region' END AS reason FROM nation),
c AS (SELECT *, CASE WHEN c_acctbal < 0 THEN 'check balance' WHEN c_nationkey NOT IN (SELECT n_nationkey FROM n WHERE reason IS NULL) THEN 'foreign key c_nationkey' END AS reason FROM customer),
o1 AS (SELECT *, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM c WHERE reason IS NULL) THEN 'foreign key o_custkey' END AS reason FROM orders),
o AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE), reason IS NULL ORDER BY o_orderkey) > 1
 THEN 'unique o_custkey, day' ELSE reason END AS reason) FROM o1),
l0 AS (SELECT *, l_orderkey * 10 + l_linenumber AS id FROM lineitem),
l1 AS (SELECT *, CASE WHEN l_orderkey NOT IN (SELECT o_orderkey FROM o WHERE reason IS NULL) THEN 'foreign key l_orderkey' END AS reason FROM l0),
l AS (SELECT * REPLACE (CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY l_orderkey, l_partkey, reason IS NULL ORDER BY id, l_suppkey, l_extendedprice, l_shipdate) > 1
 THEN 'unique l_orderkey, l_partkey' ELSE reason END AS reason) FROM l1)
SELECT 'nation' AS tab, CAST(n_nationkey AS BIGINT) AS id, reason FROM n UNION ALL SELECT 'customer', c_custkey, reason FROM c
UNION ALL SELECT 'orders', o_orderkey, reason FROM o UNION ALL SELECT 'lineitem', id, reason FROM l""")
def constraint_split(spark, sf):
    t = lambda n: T.table(spark, sf, n)
    batch = {
        "nation": t("nation"), "customer": t("customer"),
        "orders": t("orders").withColumn("day", F.to_date("o_orderdate")),
        "lineitem": t("lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))}
    rules = [
        C.Rules("nation", ("n_nationkey",), {"region": F.col("n_regionkey") != 3}, references=[C.Reference(("n_regionkey",), "region", ("r_regionkey",))]),
        C.Rules("customer", ("c_custkey",), {"balance": F.col("c_acctbal") >= 0}, references=[C.Reference(("c_nationkey",), "nation", ("n_nationkey",))]),
        C.Rules("orders", ("o_orderkey",), unique=[("o_custkey", "day")], references=[C.Reference(("o_custkey",), "customer", ("c_custkey",))]),
        C.Rules("lineitem", ("id", "l_suppkey", "l_extendedprice", "l_shipdate"), unique=[("l_orderkey", "l_partkey")], references=[C.Reference(("l_orderkey",), "orders", ("o_orderkey",))])]
    found = C.split(batch, {"region": t("region")}, rules)
    out = []
    for r in rules:
        good, bad = found[r.table]
        rows = good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)
        out.append(rows.select(F.lit(r.table).alias("tab"), F.col(r.order[0]).cast("bigint").alias("id"), "reason"))
    return reduce(DataFrame.unionByName, out)


@query("transactional_upsert", """
WITH people AS (SELECT c_custkey AS k, c_name || CASE WHEN c_custkey % 2 = 0 THEN ' (checked)' ELSE '' END AS name FROM customer),
counts AS (SELECT o_custkey AS k, count(*) AS orders FROM orders GROUP BY 1)
SELECT p.k, p.name, coalesce(c.orders, 0) AS orders, CAST(4 AS INTEGER) AS version FROM people p LEFT JOIN counts c USING (k)""")
def transactional_upsert(spark, sf):
    """Four commits count: two tables created, one changed beside a reader's snapshot, one by a writer that had to start anew."""
    tables = X.Tables(spark, run_dir(spark, "transactions"))
    people = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    with tables.begin() as tx:
        tx.write("people", people)
    orders = T.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    with tables.begin() as tx:
        tx.write("counts", orders.filter("false"))
    slow, fast = tables.begin(), tables.begin()
    checked = F.when(F.pmod("k", F.lit(2)) == 0, F.concat("name", F.lit(" (checked)"))).otherwise(F.col("name"))
    slow.write("people", slow.read("people").withColumn("name", F.lit("lost")))
    fast.write("people", fast.read("people").withColumn("name", checked))
    other = tables.begin()  # touches another table: it is not in the way
    other.write("counts", S.upsert_latest(other.read("counts"), orders, ["k"], "orders"))
    fast.commit()
    other.commit()
    try:
        slow.commit()
    except X.Conflict:
        pass
    try:
        with tables.begin() as tx:
            tx.write("people", people.limit(0))
            raise ValueError("the writer failed")
    except ValueError:
        pass
    return tables.read("people").join(tables.read("counts"), "k", "left").select(
        "k", "name", F.coalesce("orders", F.lit(0)).alias("orders"), F.lit(tables.version()).alias("version"))


@query("graph_bulk_load", M.with_(M.EDGES) + """
SELECT subject_uri, predicate, object_uri, confidence, 'out' AS part FROM edges WHERE predicate IN ('has_project', 'affiliated_with')
UNION ALL SELECT subject_uri, predicate, object_uri, confidence, 'in' FROM edges WHERE predicate IN ('has_project', 'affiliated_with')
UNION ALL SELECT subject_uri, predicate, object_uri, confidence, 'foreign key ' || CASE WHEN predicate = 'broader' THEN 'subject_uri' ELSE 'object_uri' END FROM edges WHERE predicate IN ('located_in', 'broader')""")
def graph_bulk_load(spark, sf):
    """Places are not loaded, so edges to them are set aside; everything is loaded twice."""
    path = run_dir(spark, "graph")
    nodes = T.entity_registry(spark, sf, ["Person", "Organization", "Project"]).select("uri", "entity_text", "entity_type")
    edges = T.relationships(spark, sf).select("subject_uri", "predicate", "object_uri", "confidence")
    G.load_graph(nodes, edges, path, 16)
    refused = G.load_graph(nodes, edges, path, 16)
    columns = ["subject_uri", "predicate", "object_uri", "confidence"]
    sides = [G.read_table(spark, path, side).select(*columns, F.lit(side).alias("part")) for side in (G.OUT, G.IN)]
    return sides[0].unionByName(sides[1]).unionByName(refused.select(*columns, F.col("reason").alias("part")))
