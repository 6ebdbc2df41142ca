import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import extraction as P
from kgspark.operators import graph as G
from kgspark.operators import traversal as V


def distances(pairs, nodes):
    out = {}
    for s in nodes:
        level, seen, hop = {s}, {}, 0
        while level:
            hop += 1
            level = {b for a, b in pairs if a in level} - set(seen)
            seen.update(dict.fromkeys(level, hop))
        out.update({(s, t): h for t, h in seen.items()})
    return out


@pytest.mark.parametrize("shape", ["chain", "random"])
def test_closure(spark, shape):
    """A chain far longer than its rounds; a random graph with cycles, loops, repeats and null ends."""
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(70)] if shape == "chain" else [(rnd.randrange(40), rnd.randrange(40)) for _ in range(60)]
    pairs = pairs + pairs[:5] + ([(7, 7)] if shape == "random" else [])
    edges = spark.createDataFrame([*pairs, (None, 3)], "from_id long, to_id long")
    want = distances(set(pairs), {a for a, _ in pairs})
    assert {(r.from_id, r.to_id): r.hops for r in V.closure(edges).collect()} == want
    assert V.closure(edges.limit(0)).count() == 0
    start = spark.createDataFrame([(pairs[0][0],), (pairs[3][0],), (pairs[0][0],)], "entity_id long")
    if shape == "random":
        got = {(r.start_id, r.node_id): r.hops for r in V.reachable(edges, start).collect()}
        assert got == {k: h for k, h in want.items() if k[0] in (pairs[0][0], pairs[3][0]) and k[0] != k[1]} | {(s, s): 0 for s in (pairs[0][0], pairs[3][0])}
    assert max(r.hops for r in V.reachable(edges, start, 2).collect()) == 2


def test_motif(spark):
    rnd = random.Random(4)
    rows = {(rnd.randrange(12), rnd.choice("kl"), rnd.randrange(12)) for _ in range(80)}
    edges = spark.createDataFrame([(f"{a}", p, f"{b}") for a, p, b in rows] * 2, "subject_uri string, predicate string, object_uri string")
    pattern = [("x", "k", "y"), ("y", "l", "z"), ("x", None, "z")]
    any_edge = {(a, b) for a, _, b in rows}
    want = {(a, b, d) for a, p, b in rows if p == "k" for c, q, d in rows if q == "l" and c == b and (a, d) in any_edge}
    got = V.motif(edges, pattern).select("x", "y", "z").collect()
    assert sorted(map(tuple, got)) == sorted(tuple(map(str, m)) for m in want) and want
    apart = V.motif(edges, pattern, distinct=True).select("x", "y", "z").collect()
    assert sorted(map(tuple, apart)) == sorted(tuple(map(str, m)) for m in want if len(set(m)) == 3)
    loops = V.motif(edges, [("x", "k", "x")])
    assert sorted(r.x for r in loops.collect()) == sorted(str(a) for a, p, b in rows if p == "k" and a == b)
    with pytest.raises(ValueError, match="not connected"):
        V.motif(edges, [("x", "k", "y"), ("u", "k", "v")])


def test_page_with_total(spark):
    df = spark.range(100).filter("id % 3 = 0")
    rows, total = G.page_with_total(df, [F.desc("id")], 5, 2)
    assert total == 34 and sorted(r.id for r in rows.collect()) == [81, 84, 87, 90, 93]
    assert G.page_with_total(df.limit(0), [F.col("id")], 5)[1] == 0


def test_relations_to_edges(spark):
    named = spark.createDataFrame([("d1", " Ann ", "u:1", 1), ("d1", "ann", "u:2", 2), ("d1", "Bo", "u:3", 3), ("d2", "ann", "u:9", 1)], "rid string, name string, uri string, n int")
    rel = [("d1", "ANN", "knows", "bo", 0.5), ("d1", "Ann", "knows", "bo ", 0.8), ("d1", "ann", "knows", "Ann", 0.9), ("d1", "Zed", "knows", "Bo", 0.7),
           ("d2", "ann", "knows", "bo", 0.6), ("d2", "x", "knows", "y", 0.6), ("d3", None, "knows", "Bo", 0.1)]
    edges, pending = P.relations_to_edges(spark.createDataFrame(rel, "rid string, subject string, predicate string, object string, confidence double"), named, "rid", "n")
    assert [tuple(r) for r in edges.collect()] == [("u:2", "knows", "u:3", 0.8, "d1")]
    assert sorted(tuple(r) for r in pending.select("rid", F.coalesce("subject_uri", "object_uri"), "unknown_side", "raw_unknown_label").collect()) == [
        ("d1", "u:3", "subject", "Zed"), ("d2", "u:9", "object", "bo")]
