"""Keyed stream state: cross-references and peers' failures, one fold per key.

State lives in the RocksDB store under the query's checkpoint, so a micro-batch
touches only the keys it holds and a repeated one starts from the state before
it. What changed is written per batch id; ``current`` folds the changes.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any, Optional, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from kgspark import fixed
from kgspark.functions import text as X
from kgspark.operators import events as E
from kgspark.session import cut_lineage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.datetime(1970, 1, 1)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class FailureFold(StatefulProcessor):
    """Consecutive failures of a peer, in the order of arrival and of ``at`` inside a micro-batch.

    A failure sets a timer to the end of its waiting time; when event time
    passes it without a newer outcome, the peer is reported as due again.
    """

    SCHEMA = "peer string, kind string, failures int, wait_seconds double, skipped boolean, due timestamp"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("failures", "failures int, due_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        failures, due = self.state.get() if self.state.exists() else (0, None)
        before = due
        for row in sorted(rows, key=lambda r: (r["at"], r["id"])):
            failures = 0 if row["ok"] else failures + 1
            wait = waiting(failures)
            due = round(((row["at"].replace(tzinfo=None) - EPOCH).total_seconds() + wait) * 1000) if failures else None
        if before is not None and before != due:
            self.handle.deleteTimer(before)
        if due is not None and before != due:
            self.handle.registerTimer(due)
        self.state.update((failures, due))
        yield self._row(key, "outcome", failures, due)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        failures, due = self.state.get() if self.state.exists() else (0, None)
        if due is not None and due == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((failures, None))
            yield self._row(key, "due", failures, due)

    def _row(self, key: Any, kind: str, failures: int, due: Optional[int]) -> Row:
        at = EPOCH + dt.timedelta(milliseconds=due) if due is not None else None
        return Row(peer=key[0], kind=kind, failures=failures, wait_seconds=waiting(failures), skipped=kind == "outcome" and failures > fixed.MAX_PEER_FAILURES, due=at)

    def close(self) -> None:
        pass


def waiting(failures: int) -> float:
    """Seconds a peer waits after so many failures in a row."""
    if not failures:
        return 0.0
    return float(min(fixed.BACKOFF_BASE_SECONDS * 2.0 ** min(failures - 1, 60), fixed.BACKOFF_MAX_SECONDS))


class CrossRefFold(StatefulProcessor):
    """State of one (rid, source_node) under the rules of the queue, event by event.

    FORGET deletes; a first event inserts; an unresolved state is upgraded by a
    resolved event; an UPDATE replaces what differs.
    """

    SCHEMA = "rid string, source_node string, action string, local_uri string, relationship string, confidence double"
    STATE = "local_uri string, relationship string, confidence double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ref", self.STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = tuple(self.state.get()) if self.state.exists() else None
        now = before
        for row in sorted(rows, key=lambda r: (r["queued_at"], r["id"])):
            new = (row["local_uri"], row["relationship"], row["confidence"])
            if row["event_type"] == "FORGET":
                now = None
            elif now is None or row["event_type"] == "UPDATE" or (now[1] == "unresolved" and new[1] != "unresolved"):
                now = new
        if now == before:
            return
        if now is None:
            self.state.clear()
        else:
            self.state.update(now)
        action = "deleted" if now is None else "inserted" if before is None else "updated"
        yield Row(rid=key[0], source_node=key[1], action=action, local_uri=now and now[0], relationship=now and now[1], confidence=now and now[2])

    def close(self) -> None:
        pass


def write_changes(changes: DataFrame, path: str, checkpoint: str, seconds: Optional[float] = None) -> StreamingQuery:
    """Runs a fold and writes what each micro-batch changed under its id, so a repeated batch replaces its own rows.

    Without ``seconds`` the query takes what is there and stops.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = changes.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds is not None else writer.trigger(availableNow=True)).start()


def current(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key among the changes (those of the latest batch); partial maxima before the shuffle."""
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def track_failures(outcomes: DataFrame, path: str, checkpoint: str, seconds: Optional[float] = None, late: str = "0 seconds") -> StreamingQuery:
    """Failure state of every peer from poll outcomes (peer, at, id, ok); timers follow the event time ``at``."""
    use_rocksdb(outcomes.sparkSession)
    folded = outcomes.withWatermark("at", late).groupBy("peer").transformWithState(FailureFold(), FailureFold.SCHEMA, "Update", "EventTime")
    return write_changes(folded, path, checkpoint, seconds)


def failure_state(changes: DataFrame) -> DataFrame:
    """Newest outcome of each peer, and whether its waiting time has passed since."""
    outcome = current(changes.filter("kind = 'outcome'"), ["peer"]).drop("kind")
    due = changes.filter("kind = 'due'").select("peer", "due", F.lit(True).alias("is_due")).distinct()
    return outcome.join(due, ["peer", "due"], "left").withColumn("is_due", F.coalesce("is_due", F.lit(False)))


def surface_index(registry: DataFrame) -> DataFrame:
    """(tier, form, kind, uri): what an exact or alias form means, per type and (kind '') for a mention without one."""
    forms = F.array(
        F.struct(F.lit(1).alias("tier"), F.array("normalized_text").alias("forms")),
        F.struct(F.lit(2).alias("tier"), F.transform("aliases", X.normalize_alias).alias("forms")))
    known = registry.select("uri", F.explode(F.array("entity_type", F.lit(""))).alias("kind"), "normalized_text", "aliases")
    known = known.select("uri", "kind", F.explode(forms).alias("f")).select("uri", "kind", "f.tier", F.explode("f.forms").alias("form"))
    return known.groupBy("tier", "form", "kind").agg(F.min("uri").alias("uri"))


def resolve_stream(events: DataFrame, registry: DataFrame) -> DataFrame:
    """``resolution_rows`` for a stream: stream-static joins with the registry's forms, read once from a written table."""
    index = cut_lineage(surface_index(registry), "surface-index")
    name, kind = F.col("entity_name"), F.coalesce("entity_type", F.lit(""))
    out = events.withColumns({"__kind": kind, "__1": X.normalize_name(name), "__2": X.normalize_alias(name)})
    for tier in (1, 2):
        forms = index.filter(F.col("tier") == tier).select(F.col("form").alias(f"__{tier}"), F.col("kind").alias("__kind"), F.col("uri").alias(f"__uri{tier}"))
        out = out.join(forms, [f"__{tier}", "__kind"], "left")
    sought = (F.col("event_type") != "FORGET") & (name != "")
    uri = F.when(sought, F.coalesce("__uri1", "__uri2"))
    return out.select(
        *events.columns, F.coalesce(uri, F.concat(F.lit("unresolved:"), "entity_type", F.lit(":"), "entity_name")).alias("local_uri"),
        F.when(uri.isNotNull(), "same_as").otherwise("unresolved").alias("relationship"), F.when(uri.isNotNull(), 1.0).otherwise(0.0).alias("confidence"))


def fold_input(events: DataFrame, registry: DataFrame) -> DataFrame:
    """What the fold looks at, and no more: contents and texts are not shuffled to the state, nor turned into Python rows there."""
    resolved = resolve_stream(E.parse_contents(events), registry)
    return resolved.select("rid", "source_node", "queued_at", "id", "event_type", "local_uri", "relationship", "confidence")


def fold_cross_refs(events: DataFrame, registry: DataFrame, path: str, checkpoint: str, seconds: Optional[float] = None) -> StreamingQuery:
    """Keeps the cross-references up to date from a stream of parsed or raw queue events; writes changed keys only."""
    use_rocksdb(events.sparkSession)
    folded = fold_input(events, registry).groupBy("rid", "source_node").transformWithState(CrossRefFold(), CrossRefFold.SCHEMA, "Update", "None")
    return write_changes(folded, path, checkpoint, seconds)


def cross_refs(changes: DataFrame) -> DataFrame:
    return current(changes, ["rid", "source_node"]).filter("action <> 'deleted'").drop("action")
