"""What joins let through stays near the result: rows that meet are counted in the executed plan."""

from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import functions as F

from kgspark.operators import graph as G
from kgspark.operators import notes as N
from kgspark.operators import resolve as R
from kgspark.plans import code as C
from kgspark.sources import tables as T


def _nodes(plan):
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    else:
        yield kind, plan
        for i in range(plan.children().size()):
            yield from _nodes(plan.children().apply(i))


def most_joined(df) -> int:
    """Rows of the join that puts out most."""
    df.collect()
    joins = [plan for kind, plan in _nodes(df._jdf.queryExecution().executedPlan()) if "Join" in kind]
    return max(plan.metrics().apply("numOutputRows").value() for plan in joins)


def test_shared_documents_meet_as_lists(spark):
    pairs = spark.createDataFrame([("p", f"o{i}") for i in range(100)], "uri string, other_uri string")
    links = spark.createDataFrame([(f"d{i}", e) for e, n in (("p", 200), ("o3", 40), ("x", 200)) for i in range(n)], "document_rid string, entity_uri string")
    found = G.shared_documents(pairs, links)
    assert [tuple(r) for r in found.collect()] == [("p", "o3", 40, 0.15)]
    assert most_joined(found) <= 500  # 20,000 when every document met every listed entity


def test_packed_lists_are_bounded(spark):
    df = spark.range(2 * G.PACK_ITEMS + 10).select(F.lit("k").alias("k"), F.col("id").alias("v"))
    lists = G.packed(df.unionByName(df), "k", "v", "vs").collect()
    assert sorted(len(r.vs) for r in lists) == [10, G.PACK_ITEMS, G.PACK_ITEMS]
    assert sorted(v for r in lists for v in r.vs) == list(range(2 * G.PACK_ITEMS + 10))


def test_context_relevance_hops_meet_as_lists(spark):
    edges = [("a", "affiliated_with", f"o{i}") for i in range(50)] + [(f"o{i}", "has_project", f"j{i}") for i in range(25, 75)]
    pairs = spark.createDataFrame([("a", f"j{i}", "none") for i in range(25, 75)], "uri string, project_uri string, org_uri string")
    found = R.context_relevance(pairs, spark.createDataFrame(edges, "subject_uri string, predicate string, object_uri string"))
    assert sorted(r.project_uri for r in found.collect() if r.adjustment == 0.1) == [f"j{i}" for i in range(25, 50)]
    assert most_joined(found) <= 100  # 2,500 when every pair met every organization


SF = "/root/testdata/sf0.001"


def _bag(df):
    return Counter(map(tuple, df.collect()))


def test_numbers_stand_for_uris(spark):
    """Edges and links as numbers, turned into texts again, are the edges and links as texts."""
    cols = ["subject_uri", "predicate", "object_uri", "confidence"]
    edges = T.with_uris(spark, SF, T.relationships(spark, SF, ids=True), {"subject_uri": None, "object_uri": None})
    assert _bag(edges.select(cols)) == _bag(T.relationships(spark, SF).select(cols))
    links = T.document_links(spark, SF, ids=True).withColumn("document_rid", T.document_rid(F.col("document_rid")))
    links = T.with_uris(spark, SF, links, {"entity_uri": None})
    cols = ["document_rid", "entity_uri", "mention_count"]
    assert _bag(links.select(cols)) == _bag(T.document_links(spark, SF).select(cols))


def test_notes_of_one_path_and_link_are_distinct(spark):
    """Entities named by number; two of one path share their lines, and a target that two entities share is listed once."""
    registry = spark.createDataFrame([(1, "u1", "Ann", "Person", None), (2, "u2", "Ann", "Person", None), (3, "u3", "Org", "Organization", None)],
                                     "id long, uri string, entity_text string, entity_type string, description string")
    edges = spark.createDataFrame([(1, "affiliated_with", 3), (2, "affiliated_with", 3)], "subject_uri long, predicate string, object_uri long")
    links = spark.createDataFrame([("vault:a.md", 1), ("vault:a.md", 2)], "document_rid string, entity_uri long")
    lines = N.note_lines(registry, edges, links, spark.createDataFrame([], "document_rid string, note_path string"))
    ann = Counter((r.section, r.line) for r in lines.filter("note_path = 'People/Ann.md' AND section IN (4, 6, 13, 14)").collect())
    assert ann == Counter([(4, "affiliation:"), (4, '  - "[[Organizations/Org]]"'), (6, "mentionedIn:"), (6, '  - "[[a]]"'),
                           (13, "## Relationships"), (13, ""), (13, ""), (13, "- affiliated with: [[Organizations/Org]]"),
                           (14, "## Mentioned In"), (14, ""), (14, ""), (14, "- [[a]]")])
    org = [r.line for r in lines.filter("note_path = 'Organizations/Org.md' AND section IN (4, 13)").collect() if "Ann" in r.line]
    assert sorted(org) == ['  - "[[People/Ann]]"', "- affiliated with (from): [[People/Ann]]"]


def test_rows_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(T, "DEAL_BYTES", 1000)
    dealt = T._deal(spark, SF, "lineitem")(spark.range(10), "id")
    assert dealt.rdd.getNumPartitions() >= os.path.getsize(f"{SF}/lineitem.parquet") // 1000


def test_source_files_are_dealt_over_all_cores(spark):
    files = C._files(spark, SF, "py")
    assert files.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
