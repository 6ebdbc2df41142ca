"""Event queue semantics and the handler chain as batch transformations.

Delivery state is kept apart from the events: ``deliveries`` holds one row per
(event_id, node), so marking is an append and never a rewrite of the log.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark import fixed
from kgspark.functions import text as X


def dedup(events: DataFrame) -> DataFrame:
    """First event of each (source_node, event_id); events without an id are all kept.

    An aggregate, so copies of one hot event collapse in the map tasks.
    """
    with_id = events.filter(F.col("event_id").isNotNull())
    rest = [c for c in events.columns if c not in ("source_node", "event_id")]
    first = with_id.groupBy("source_node", "event_id").agg(
        F.min_by(F.struct(*rest), F.struct("queued_at", "id")).alias("r")
    ).select(*[F.col(c) if c in ("source_node", "event_id") else F.col(f"r.{c}").alias(c) for c in events.columns])
    return first.unionByName(events.filter(F.col("event_id").isNull()))


def live(events: DataFrame, now: Column) -> DataFrame:
    return events.filter(F.col("expires_at") > now)


def expired_count(events: DataFrame, now: Column) -> DataFrame:
    return events.agg(F.count_if(F.col("expires_at") <= now).alias("expired"), F.count_if(F.col("expires_at") > now).alias("live"))


def cleanup(events: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The queue without what has expired, and what was taken out; an event without an expiry stays."""
    gone = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    return events.filter(~gone), events.filter(gone)


def pending_for(events: DataFrame, deliveries: DataFrame, node: str, now: Column) -> DataFrame:
    """Live events not yet delivered to ``node``."""
    done = deliveries.filter(F.col("node") == node).select("event_id")
    return live(events, now).join(done, "event_id", "left_anti")


def type_allowed(rid: Column, rid_types: Optional[Sequence[str]]) -> Column:
    """Untyped identifiers pass every type filter."""
    if not rid_types:
        return F.lit(True)
    kind = X.rid_type(rid)
    return kind.isNull() | kind.isin(list(rid_types))


def peek(events: DataFrame, deliveries: DataFrame, node: str, now: Column, limit: int = fixed.POLL_LIMIT,
         rid_types: Optional[Sequence[str]] = None, filter_first: bool = False) -> DataFrame:
    """Oldest pending events of a node.

    The limit comes before the type filter, as the queue has always done; with
    ``filter_first`` a filtered consumer cannot be starved by other types.
    """
    waiting = pending_for(events, deliveries, node, now)
    keep = type_allowed(F.col("rid"), rid_types)
    if filter_first:
        return waiting.filter(keep).orderBy("queued_at", "id").limit(limit)
    return waiting.orderBy("queued_at", "id").limit(limit).filter(keep)


def mark(deliveries: DataFrame, batch: DataFrame, node: str) -> DataFrame:
    """New delivery rows for a batch; already marked events add none."""
    new = batch.select("event_id", F.lit(node).alias("node")).distinct()
    return new.join(deliveries, ["event_id", "node"], "left_anti")


def push_all_or_nothing(deliveries: DataFrame, batch: DataFrame, acks: DataFrame, node: str) -> DataFrame:
    """Delivery rows of a push: all of the batch, or none when any event was not acknowledged."""
    missing = batch.join(acks.select("event_id"), "event_id", "left_anti").limit(1).agg(F.count("*").alias("missing"))
    # One row with a count: a proven bound for the broadcast.
    return mark(deliveries, batch, node).join(F.broadcast(missing.filter("missing = 0").select(F.lit(node).alias("node"))), "node", "left_semi")


def latest_per_rid(events: DataFrame) -> DataFrame:
    """Newest event of each rid; partial maxima are taken before the shuffle."""
    rest = [c for c in events.columns if c != "rid"]
    return events.groupBy("rid").agg(F.max_by(F.struct(*rest), F.struct("queued_at", "id")).alias("r")).select("rid", "r.*")


def fetch(wanted: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Latest bundle of each wanted rid, and the rids that have none."""
    asked = wanted.select("rid").distinct()
    found = latest_per_rid(events.join(asked, "rid", "left_semi"))
    return found, asked.join(events.select("rid"), "rid", "left_anti")


def authorised(pollers: DataFrame, edges: DataFrame, strict: bool) -> DataFrame:
    """Allowed rid types of each (target_node, source_node): null means all, and in
    strict mode only approved pairs remain."""
    ok = edges.filter("status = 'APPROVED'").groupBy("target_node", "source_node").agg(
        F.first(F.when(F.size("rid_types") > 0, F.col("rid_types")), ignorenulls=True).alias("rid_types"))
    return pollers.join(ok, ["target_node", "source_node"], "inner" if strict else "left")


def parse_contents(events: DataFrame) -> DataFrame:
    """Handler step: entity type (prefix dropped) and name from the JSON contents."""
    field = lambda k: F.get_json_object("contents", f"$['{k}']")
    kind = F.coalesce(field("@type"), field("entity_type"), F.lit(""))
    return events.withColumn("entity_name", F.coalesce(field("name"), F.lit(""))).withColumn(
        "entity_type", F.regexp_replace(kind, "^" + fixed.TYPE_PREFIX, ""))


def block_self(events: DataFrame, node_rid: str) -> DataFrame:
    """Handler step: drops news about this node from anyone but itself."""
    foreign = (F.col("rid") == node_rid) & F.col("source_node").isNotNull() & (F.col("source_node") != node_rid)
    return events.filter(~F.coalesce(foreign, F.lit(False)))


class Handler:
    """One step of the chain: a frame transformation for chosen rid and event types.

    Rows outside its types pass unchanged; rows it filters out leave the chain.
    """

    PHASES = ("rid", "manifest", "bundle", "network", "final")

    def __init__(self, phase: str, fn, rid_types: Optional[Sequence[str]] = None, event_types: Optional[Sequence[str]] = None):
        if phase not in self.PHASES:
            raise ValueError(f"unknown phase {phase}")
        self.phase, self.fn, self.rid_types, self.event_types = phase, fn, rid_types, event_types

    def __call__(self, events: DataFrame) -> DataFrame:
        cond = F.lit(True)
        if self.rid_types:
            cond = cond & X.rid_type(F.col("rid")).isin(list(self.rid_types))
        if self.event_types:
            cond = cond & F.col("event_type").isin(list(self.event_types))
        if not (self.rid_types or self.event_types):
            return self.fn(events)
        cond = F.coalesce(cond, F.lit(False))
        return self.fn(events.filter(cond)).unionByName(events.filter(~cond), allowMissingColumns=True)


def run_chain(events: DataFrame, handlers: Sequence[Handler]) -> DataFrame:
    """Handlers by phase, in the order given within a phase."""
    for h in sorted(handlers, key=lambda h: Handler.PHASES.index(h.phase)):
        events = events.transform(h)
    return events


def default_chain(node_rid: str) -> list[Handler]:
    return [Handler("rid", lambda df: block_self(df, node_rid)), Handler("rid", parse_contents)]


def resolution_rows(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds local_uri, relationship and confidence of each event's entity (exact name and alias).

    Distinct (name, type) pairs are resolved once and joined back.
    """
    from kgspark.operators import resolve as R

    names = events.filter((F.col("event_type") != "FORGET") & (F.col("entity_name") != "")).select("entity_name", "entity_type").distinct()
    mentions = names.select(F.struct("entity_name", "entity_type").alias("mention_id"), F.col("entity_name").alias("name"),
                            F.nullif("entity_type", F.lit("")).alias("entity_type"))
    hit = R.resolve(mentions, registry, mode="exact_alias", create=False).select(
        F.col("mention_id.entity_name").alias("entity_name"), F.col("mention_id.entity_type").alias("entity_type"), "uri")
    return events.join(hit, ["entity_name", "entity_type"], "left").select(
        *events.columns,
        F.coalesce("uri", F.concat(F.lit("unresolved:"), "entity_type", F.lit(":"), "entity_name")).alias("local_uri"),
        F.when(F.col("uri").isNotNull(), "same_as").otherwise("unresolved").alias("relationship"),
        F.when(F.col("uri").isNotNull(), 1.0).otherwise(0.0).alias("confidence"),
    )


def fold_cross_refs(resolved: DataFrame, existing: Optional[DataFrame] = None) -> DataFrame:
    """Cross-references after a batch of events, one per (rid, source_node).

    The per-event rules (FORGET deletes; a first event inserts; an unresolved
    row is upgraded; an UPDATE replaces) reduce to aggregates: only events after
    the last FORGET count, the last UPDATE among them (else the first event, or
    the stored row) sets the state, and if that is unresolved the first resolved
    event after it upgrades it. Two aggregations with map-side partials and one
    join, so a key with very many events is never gathered in one task.
    """
    keys = ["rid", "source_node"]
    at = F.struct("queued_at", "id")
    value = F.struct("local_uri", "relationship", "confidence")
    rows = resolved.select(*keys, "event_type", at.alias("at"), value.alias("v"))
    if existing is not None:
        zero = F.struct(F.lit("0001-01-01").cast("timestamp").alias("queued_at"), F.lit(-1).cast("bigint").alias("id"))
        old = existing.select(*keys, F.lit("STORED").alias("event_type"), zero.alias("at"), value.alias("v"))
        rows = rows.unionByName(old)
    marks = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("event_type") == "FORGET", F.col("at"))).alias("forgot"),
        F.max(F.when(F.col("event_type") == "UPDATE", F.col("at"))).alias("updated"),
    )
    alive = rows.join(marks, keys).filter(
        (F.col("event_type") != "FORGET")
        & (F.col("forgot").isNull() | (F.col("at") > F.col("forgot")))
        & (F.col("updated").isNull() | F.coalesce(F.col("updated") < F.col("forgot"), F.lit(False)) | (F.col("at") >= F.col("updated")))
    )
    state = alive.groupBy(*keys).agg(
        F.min_by("v", "at").alias("base"),
        F.min_by(F.when(F.col("v.relationship") != "unresolved", F.col("v")), F.when(F.col("v.relationship") != "unresolved", F.col("at"))).alias("first_resolved"),
    )
    final = F.when((F.col("base.relationship") == "unresolved") & F.col("first_resolved").isNotNull(), F.col("first_resolved")).otherwise(F.col("base"))
    return state.select(*keys, final.alias("f")).select(*keys, "f.local_uri", "f.relationship", "f.confidence")


def changed_refs(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a batch did to the stored cross-references: inserted, updated, deleted or unchanged."""
    keys = ["rid", "source_node"]
    a = old.select(*keys, F.struct("local_uri", "relationship", "confidence").alias("a"))
    b = new.select(*keys, F.struct("local_uri", "relationship", "confidence").alias("b"))
    moved = (F.col("a.local_uri") != F.col("b.local_uri")) | (F.col("a.relationship") != F.col("b.relationship")) | X.confidence_changed(F.col("a.confidence"), F.col("b.confidence"))
    action = F.when(F.col("a").isNull(), "inserted").when(F.col("b").isNull(), "deleted").when(moved, "updated").otherwise("unchanged")
    return a.join(b, keys, "full_outer").select(*keys, action.alias("action"))


def _hour_sums(rows: DataFrame, keys: list[str], seconds: int, name: str) -> DataFrame:
    """Rows of the trailing hour at each (key, second) that has any.

    Counting per second first bounds a window group to the seconds of two
    hours, however many rows a key has.
    """
    from pyspark.sql import Window

    per_second = rows.groupBy(*keys, "sec").agg(F.count("*").alias("n"))
    bucket = F.floor(F.col("sec") / seconds)
    spread = per_second.select(*keys, "sec", "n", F.explode(F.array(bucket, bucket + 1)).alias("bucket"))
    trailing = Window.partitionBy(*keys, "bucket").orderBy("sec").rangeBetween(-seconds + 1, 0)
    summed = spread.withColumn(name, F.sum("n").over(trailing))
    return summed.filter(F.col("bucket") == bucket).select(*keys, "sec", name)


def trailing_hour(rows: DataFrame, user: str, ts: str, seconds: int = 3600) -> DataFrame:
    """Counts of the trailing hour, per user and overall, and the limit they reach.

    Times are compared as whole seconds; a row counts itself.
    """
    timed = rows.withColumn("sec", F.col(ts).cast("timestamp").cast("long"))
    out = timed.join(_hour_sums(timed, [user], seconds, "user_hour"), [user, "sec"]).join(
        _hour_sums(timed, [], seconds, "global_hour"), "sec")
    verdict = (
        F.when(F.col("global_hour") > fixed.GLOBAL_RATE_PER_HOUR, "global")
        .when(F.col("user_hour") > fixed.USER_RATE_PER_HOUR, "user").otherwise("ok")
    )
    return out.withColumn("verdict", verdict).drop("sec")
