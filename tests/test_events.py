import datetime as dt
import random

from pyspark.sql import functions as F

from kgspark.operators import events as E
from kgspark.streaming import queue as Q

T0 = dt.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, event_id string, event_type string, rid string, source_node string, contents string, queued_at timestamp, expires_at timestamp")


def event(i, kind="NEW", rid="orn:koi-net.practice:a+1", node="n1", contents=None, event_id=None, ttl=24):
    at = T0 + dt.timedelta(minutes=i)
    return (i, event_id or f"e{i}", kind, rid, node, contents, at, at + dt.timedelta(hours=ttl))


def test_queue_rules(spark):
    ev = frame(spark, [event(1), event(2, event_id="e1"), event(3, rid="orn:koi-net.concept:b+1"), event(4, ttl=0), event(5, rid="free text")])
    none = spark.createDataFrame([], "event_id string, node string")
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    unique = E.dedup(ev)
    assert sorted(r.id for r in unique.collect()) == [1, 3, 4, 5]
    ids = lambda df: [r.id for r in df.orderBy("id").collect()]
    first = E.peek(unique, none, "p", now)
    assert ids(first) == ids(E.peek(unique, none, "p", now)) == [1, 3, 5]
    # Limit before the type filter, untyped identifiers pass.
    assert ids(E.peek(unique, none, "p", now, limit=2, rid_types=["Concept"])) == [3]
    assert ids(E.peek(unique, none, "p", now, limit=2, rid_types=["Concept"], filter_first=True)) == [3, 5]
    marked = E.mark(none, first, "p")
    assert marked.count() == 3 and E.mark(marked, first, "p").count() == 0
    assert ids(E.peek(unique, marked, "p", now)) == []
    acks = spark.createDataFrame([("e1",), ("e3",)], "event_id string")
    assert E.push_all_or_nothing(none, first, acks, "p").count() == 0
    assert E.push_all_or_nothing(none, first, first.select("event_id"), "p").count() == 3


def test_handlers(spark):
    own = "orn:koi-net.node:me+1"
    ev = frame(spark, [event(1, rid=own, node="other"), event(2, rid=own, node=own), event(3, rid=own, node=None),
                       event(4, contents='{"@type":"bkc:Practice","name":"N"}'), event(5, kind="FORGET", contents='{"entity_type":"Claim"}')])
    seen = []
    handlers = E.default_chain(own) + [
        E.Handler("final", lambda df: df.withColumn("mark", F.lit("late"))),
        E.Handler("bundle", lambda df: df.filter("event_type <> 'FORGET'"), event_types=["FORGET"]),
        E.Handler("network", lambda df: seen.append(1) or df, rid_types=["Practice"])]
    out = {r.id: (r.entity_type, r.entity_name, r.mark) for r in E.run_chain(ev, handlers).collect()}
    assert out == {2: ("", "", "late"), 3: ("", "", "late"), 4: ("Practice", "N", "late")} and seen


def step(state, kind, new):
    if kind == "FORGET":
        return None
    if state is None or (state[1] == "unresolved" and new[1] != "unresolved") or (kind == "UPDATE" and state != new):
        return new
    return state


def test_cross_reference_fold_equals_one_by_one(spark):
    rng = random.Random(11)
    values = [("u1", "same_as", 1.0), ("u2", "related_to", 0.9), ("unresolved:P:x", "unresolved", 0.0)]
    rows, want = [], {}
    for k in range(60):
        state = None
        if k % 3 == 0:
            state = rng.choice(values)
        stored = state
        n = rng.randint(1, 8)
        for i in range(n):
            kind, v = rng.choice(["NEW", "UPDATE", "FORGET", "NEW"]), rng.choice(values)
            rows.append((k * 100 + i, kind, f"r{k}", "n", T0 + dt.timedelta(seconds=i), *v, stored))
            state = step(state, kind, v)
        if state:
            want[f"r{k}"] = state
    batch = spark.createDataFrame([r[:8] for r in rows], "id long, event_type string, rid string, source_node string, queued_at timestamp, local_uri string, relationship string, confidence double")
    old = spark.createDataFrame([(r, "n", *s) for r, s in {r[2]: r[8] for r in rows if r[8]}.items()], "rid string, source_node string, local_uri string, relationship string, confidence double")
    got = {r.rid: (r.local_uri, r.relationship, r.confidence) for r in E.fold_cross_refs(batch, old).collect()}
    assert got == want
    actions = {r.action for r in E.changed_refs(old, E.fold_cross_refs(batch, old)).collect()}
    assert {"inserted", "deleted"} <= actions


def test_failure_counts(spark):
    old = spark.createDataFrame([("a", 2), ("b", 3), ("c", 1)], "peer string, failures int")
    out = spark.createDataFrame([("a", "1", False), ("a", "2", False), ("b", "1", True), ("b", "2", False), ("d", "1", True)], "peer string, at string, ok boolean")
    got = {r.peer: (r.failures, r.skipped) for r in Q.fold_failures(out, old).collect()}
    assert got == {"a": (4, True), "b": (1, False), "c": (1, False), "d": (0, False)}


def test_authorised(spark):
    pollers = spark.createDataFrame([("a", "s"), ("b", "s")], "target_node string, source_node string")
    edges = spark.createDataFrame([("a", "s", "APPROVED", ["Person"]), ("b", "s", "PROPOSED", [])], "target_node string, source_node string, status string, rid_types array<string>")
    assert {r.target_node: r.rid_types for r in E.authorised(pollers, edges, True).collect()} == {"a": ["Person"]}
    assert {r.target_node: r.rid_types for r in E.authorised(pollers, edges, False).collect()} == {"a": ["Person"], "b": None}
