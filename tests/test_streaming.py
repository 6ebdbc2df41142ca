"""Streams over several micro-batches, with failures and restarts, against batch results."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from kgspark.operators import events as E
from kgspark.sources import peers as P
from kgspark.streaming import delivery as D
from kgspark.streaming import queue as Q
from kgspark.streaming import state as K

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, event_id string, event_type string, rid string, source_node string, contents string, queued_at timestamp, expires_at timestamp, peer string"


def queue_rows(n, seed=5):
    rnd = random.Random(seed)
    name = lambda: json.dumps({"@type": "bkc:Person", "name": rnd.choice(["Ann", "[[People/Bo]]", "bobby", "Zed", ""])})
    rows = []
    for i in range(n):
        at = T0 + dt.timedelta(minutes=i)
        peer = rnd.choice(["orn:koi-net.node:a+1", "b", "c d"])
        rows.append((i, f"e{i}", rnd.choice(["NEW", "UPDATE", "FORGET", "NEW"]), f"r{rnd.randint(0, 9)}", peer, name(), at, at + dt.timedelta(hours=24), peer))
    return rows


def drain(query):
    query.processAllAvailable()
    query.stop()


@pytest.fixture(scope="module")
def registry(spark):
    rows = [("u:ann", "Ann", "Person", "ann", []), ("u:bo", "Bo", "Person", "bo", ["Bobby"])]
    return spark.createDataFrame(rows, "uri string, entity_text string, entity_type string, normalized_text string, aliases array<string>")


def test_peer_source(spark, tmp_path):
    """Each event is read once, by offset per peer, over restarts, new files and new peers."""
    rows = queue_rows(90)
    events = spark.createDataFrame(rows, SCHEMA)
    P.write_peer_files(events.filter("id < 60"), f"{tmp_path}/in", "queued_at", 3)

    def run():
        stream = P.read_peers(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/progress", files_per_trigger=1)
        query = Q.to_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp", 0)
        drain(query)
        return [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]

    first = run()
    assert len(first) >= 3 and sum(first) == 60
    assert run() == []
    later = events.filter("id >= 60").withColumn("peer", F.when(F.col("id") < 80, F.col("peer")).otherwise("new one"))
    later.repartition(1).withColumn("slice", F.lit("000009")).write.mode("append").partitionBy("peer", "slice").parquet(f"{tmp_path}/in")
    assert sum(run()) == 30
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.id for r in got.collect()) == list(range(90))
    want = {r.id: r for r in events.drop("peer").collect()}
    assert all(tuple(want[r.id]) == tuple(r)[:8] for r in got.select(*events.columns).collect())
    assert {r.peer for r in got.collect()} == {"orn:koi-net.node:a+1", "b", "c d", "new one"}


def test_peer_plan_survives_a_crash(spark, tmp_path):
    """What was planned before a crash is read with the next batch; the offset never moves backwards; intervals hold."""
    events = spark.createDataFrame(queue_rows(40), SCHEMA)
    P.write_peer_files(events, f"{tmp_path}/in", "queued_at", 4)
    reader = lambda **more: P.PeerReader({"path": f"{tmp_path}/in", "progress": f"{tmp_path}/p", "filespertrigger": "1", **more}, events.schema)
    one = reader()
    start = one.latestOffset()
    assert len(one.partitions({}, start)) == 3 and one.partitions(start, start) == []
    two = reader()  # the first offset was planned, but no batch ran
    ahead = two.latestOffset()
    assert all(ahead[p] > start[p] for p in start)
    seen = [(p.peer, p.uri) for p in two.partitions({}, ahead)]
    assert len(seen) == len(set(seen)) == 6
    slow = reader(pollseconds="1000")
    assert slow.latestOffset() != ahead and slow.latestOffset() == slow.latestOffset()
    batches = [b for p in two.partitions({}, ahead) for b in two.read(p)]
    assert sum(b.num_rows for b in batches) == events.join(spark.createDataFrame([(b,) for b in range(2)], "k int"), F.floor(F.col("id") / 10) == F.col("k")).count()


def test_cross_references(spark, tmp_path, registry):
    """Several micro-batches, one of them run again after a failure, give the batch result, and only touched keys are written."""
    rows = queue_rows(120)
    events = spark.createDataFrame(rows, SCHEMA)
    P.write_peer_files(events, f"{tmp_path}/in", "queued_at", 4)

    def start(fail):
        stream = P.read_peers(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/progress", files_per_trigger=1)
        K.use_rocksdb(spark)
        folded = K.resolve_stream(E.parse_contents(stream), registry).groupBy("rid", "source_node").transformWithState(K.CrossRefFold(), K.CrossRefFold.SCHEMA, "Update", "None")
        if not fail:
            return K.write_changes(folded, f"{tmp_path}/out", f"{tmp_path}/cp", 0)

        def step(batch, batch_id):
            batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch_id}")
            if batch_id == 2:
                raise RuntimeError("lost")

        return folded.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="0 seconds").start()

    with pytest.raises(Exception, match="lost"):
        drain(start(True))
    drain(start(False))
    changes = spark.read.schema(K.CrossRefFold.SCHEMA + ", batch long").parquet(f"{tmp_path}/out")
    want = E.fold_cross_refs(E.resolution_rows(E.parse_contents(events.drop("peer")), registry))
    got = K.cross_refs(changes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect())) and got.count()
    sizes = {r.batch: r.n for r in changes.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    touched = events.groupBy(F.floor(F.col("id") / 30).alias("b")).agg(F.countDistinct("rid", "source_node").alias("n"))
    assert len(sizes) >= 4 and max(sizes.values()) <= max(r.n for r in touched.collect())


def test_peer_failures(spark, tmp_path):
    rows = [("a", 0, True), ("a", 10, False), ("a", 20, False), ("b", 5, False), ("b", 6, True), ("c", 1, False), ("c", 2, False), ("c", 3, False), ("c", 4, False),
            ("d", 1, False), ("d", 999, False), ("e", 1, False), ("e", 998, True), ("f", 1000, True)]
    outcomes = spark.createDataFrame([(p, T0 + dt.timedelta(seconds=s), i, ok) for i, (p, s, ok) in enumerate(rows)], "peer string, at timestamp, id long, ok boolean")
    P.write_peer_files(outcomes, f"{tmp_path}/in", "at", 2)
    stream = P.read_peers(spark, f"{tmp_path}/in", outcomes.schema, f"{tmp_path}/progress", files_per_trigger=1)
    drain(K.track_failures(stream, f"{tmp_path}/out", f"{tmp_path}/cp", 0))
    changes = spark.read.schema(K.FailureFold.SCHEMA + ", batch long").parquet(f"{tmp_path}/out")
    got = {r.peer: (r.failures, r.wait_seconds, r.skipped, r.is_due) for r in K.failure_state(changes).collect()}
    assert got == {"a": (2, 60.0, False, True), "b": (0, 0.0, False, False), "c": (4, 240.0, True, True),
                   "d": (2, 60.0, False, False), "e": (0, 0.0, False, False), "f": (0, 0.0, False, False)}
    assert K.waiting(5) == 480.0 and K.waiting(6) == K.waiting(10**6) == 600.0


def test_confirmed_delivery(spark, tmp_path):
    """A failing consumer gets exactly the unconfirmed events again; a repeated round offers the same events."""
    events = spark.createDataFrame(queue_rows(20), SCHEMA)
    log = D.DeliveryLog(spark, f"{tmp_path}/log", events.schema)
    seen = []

    def consumer(fails):
        def consume(offered):
            seen.append(sorted((r.id, r.attempt) for r in offered.collect()))
            if fails is None:
                raise RuntimeError("down")
            return offered.filter(~F.col("id").isin(*fails)) if fails else offered
        return consume

    early = events.filter("id < 12")
    log.round(early, 0, consumer([3, 7]))
    with pytest.raises(RuntimeError):
        log.round(events, 1, consumer(None))
    log.round(spark.createDataFrame([], events.schema), 1, consumer([7, 13]))  # the round runs again
    log.round(events, 2, consumer([]))
    fresh = [(i, 1) for i in range(12, 20)]
    assert seen[0] == [(i, 1) for i in range(12)] and seen[1] == seen[2] == [(3, 2), (7, 2), *fresh]
    assert seen[3] == [(7, 3), (13, 2)] and log.unconfirmed().count() == 0
    assert sorted(r.event_id for r in log.confirmed().collect()) == sorted(f"e{i}" for i in range(20))
    late = events.withColumn("event_id", F.concat(F.lit("x"), "event_id"))
    now = F.lit("2024-01-02 00:05:00").cast("timestamp")
    assert [r.id for r in log.offer(late, 3, now, 4).orderBy("id").collect()] == [6, 7, 8, 9]
    assert log.settle(consumer([]), 5) == 1


def test_delivery_stream(spark, tmp_path):
    events = spark.createDataFrame(queue_rows(30), SCHEMA)
    P.write_peer_files(events, f"{tmp_path}/in", "queued_at", 3)
    log = D.DeliveryLog(spark, f"{tmp_path}/log", events.schema)
    stream = P.read_peers(spark, f"{tmp_path}/in", events.schema, f"{tmp_path}/progress", files_per_trigger=1)
    consume = lambda offered: offered.filter(F.col("attempt") > F.pmod(F.col("id"), F.lit(2)))
    drain(D.deliver_stream(stream, log, consume, f"{tmp_path}/cp", 0))
    log.settle(consume, 2)
    tries = {r.id: r.n for r in log.delivered().groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert tries == {i: i % 2 + 1 for i in range(30)} and log.confirmed().count() == 30
