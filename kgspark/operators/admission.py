"""Admission of submissions under hourly limits.

A refused submission does not count towards later ones, so verdicts follow one
another in time. Time is cut into segments; the state at a segment's end (what
was admitted in the last hour, at most the global limit of entries) is the start of
the next. Starts are found on packed segments (times and user numbers): chunks of
consecutive segments are folded side by side, and chunks whose start turns out
different are folded again, until no start changes. There are as many chunks as
segments in a chunk, so the rounds are at most the root of the segments, and a round
writes starts alone. Verdicts come from one last fold of all segments.
"""

from __future__ import annotations

import math
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark import fixed
from kgspark.session import cut_lineage

#: Submissions of a segment, about.
SEGMENT_ROWS = 50_000


class Limits:
    """Folds submissions in order; ``entries`` are the admitted (second, user) of the last hour."""

    def __init__(self, user_limit: int, global_limit: int, seconds: int, entries: list[tuple] = ()):
        self.user_limit, self.global_limit, self.seconds = user_limit, global_limit, seconds
        self.entries = deque(entries)
        self.per_user = Counter(u for _, u in entries)

    @property
    def full(self) -> bool:
        return len(self.entries) >= self.global_limit

    def verdict(self, second: int, user: str) -> str:
        while self.entries and self.entries[0][0] <= second - self.seconds:
            self.per_user[self.entries.popleft()[1]] -= 1
        if self.full:
            return "global"
        if user and self.per_user[user] >= self.user_limit:
            return "user"
        self.entries.append((second, user))
        self.per_user[user] += 1
        return "ok"


def _ordered(rows: pa.Table, order: str) -> pa.Table:
    return rows.sort_by([("__sec", "ascending"), ("__micros", "ascending"), (order, "ascending")])


def _entries(start: pa.Table) -> list[tuple]:
    given = start.to_pylist()
    return list(zip(given[0]["start_sec"], given[0]["start_user"])) if given else []


def _fold(order: str, user_limit: int, global_limit: int, seconds: int):
    """Verdicts of a segment from its start."""

    def run(rows: pa.Table, start: pa.Table) -> pa.Table:
        rows = _ordered(rows, order)
        limits = Limits(user_limit, global_limit, seconds, _entries(start))
        verdicts, full = [], []
        for second, user in zip(rows.column("__sec").to_pylist(), rows.column("__user").to_pylist()):
            verdicts.append(limits.verdict(second, user))
            full.append(limits.full)
        return _with(rows, verdicts, full)

    return run


_PACKED = "__segment int, secs binary, users binary, names array<string>"


def _pack(order: str):
    def run(rows: pa.Table) -> pa.Table:
        rows = _ordered(rows.select(["__segment", "__sec", "__micros", "__user", order]), order)
        users = rows.column("__user").combine_chunks().dictionary_encode()
        return pa.Table.from_pydict({
            "__segment": pa.array([rows.column("__segment")[0].as_py()], pa.int32()), "secs": pa.array([rows.column("__sec").to_numpy().astype("<i8").tobytes()], pa.binary()),
            "users": pa.array([users.indices.to_numpy().astype("<i4").tobytes()], pa.binary()), "names": pa.array([users.dictionary.to_pylist()], pa.list_(pa.string()))})

    return run


_STATES = "__chunk int, __segment int, start_sec array<long>, start_user array<string>"


def _chain(user_limit: int, global_limit: int, seconds: int):
    """Start of each segment of a chunk; the row whose segment is null has the start of the next chunk."""

    def run(key: tuple, segments: pa.Table, start: pa.Table) -> pa.Table:
        limits = Limits(user_limit, global_limit, seconds, _entries(start))
        states = []
        for row in segments.sort_by("__segment").to_pylist():
            states.append((row["__segment"], list(limits.entries)))
            names = row["names"]
            for second, user in zip(np.frombuffer(row["secs"], "<i8").tolist(), np.frombuffer(row["users"], "<i4").tolist()):
                limits.verdict(second, names[user])
        if states:
            states.append((None, list(limits.entries)))
        chunk = key[0].as_py()
        columns = ([chunk] * len(states), [x for x, _ in states], [[s for s, _ in e] for _, e in states], [[u for _, u in e] for _, e in states])
        kinds = (pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["__chunk", "__segment", "start_sec", "start_user"])

    return run


def _with(rows: pa.Table, verdicts: list, full: list) -> pa.Table:
    return rows.append_column("verdict", pa.array(verdicts, pa.string())).append_column("__full", pa.array(full, pa.bool_()))


def admit(rows: DataFrame, user: str, ts: str, order: str, user_limit: int = fixed.USER_RATE_PER_HOUR,
          global_limit: int = fixed.GLOBAL_RATE_PER_HOUR, seconds: int = 3600, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``rows`` with ``verdict``: ok (admitted), or the limit that refused: global, else user.

    Submissions come by ``ts``, ties by ``order``; times are compared as whole
    seconds. A submission without a user has no limit of its own. Limits change
    for the better only from one second to the next, so of one user and second
    no more rows than the limit can be admitted: the others are judged by when
    the global limit was reached in their second, and never enter a fold.
    """
    at = F.col(ts).cast("timestamp")
    timed = rows.withColumns({"__sec": at.cast("long"), "__micros": F.unix_micros(at), "__user": F.coalesce(F.col(user).cast("string"), F.lit(""))})
    rank = F.row_number().over(Window.partitionBy("__sec", "__user").orderBy("__micros", order))
    most = F.when(F.col("__user") == "", global_limit).otherwise(user_limit)
    ranked = timed.withColumn("__late", rank > most)
    ranked = cut_lineage(ranked, "submissions")
    chosen = ranked.filter(~F.col("__late")).drop("__late")
    parts = max(1, math.ceil(chosen.count() / segment_rows))
    segments = cut_lineage(chosen.repartitionByRange(parts, "__sec").withColumn("__segment", F.spark_partition_id()), "segments")
    starts = _starts(segments, order, parts, user_limit, global_limit, seconds)
    schema = T.StructType(list(segments.schema.fields)).add("verdict", "string").add("__full", "boolean")
    folded = segments.groupBy("__segment").cogroup(starts.groupBy("__segment")).applyInArrow(_fold(order, user_limit, global_limit, seconds), schema)
    done = cut_lineage(folded, "folded")
    reached = done.filter("__full").groupBy("__sec").agg(F.min(F.struct("__micros", order)).alias("__from"))
    late = ranked.filter("__late").join(reached, "__sec", "left")
    is_full = F.coalesce(F.struct("__micros", order) > F.col("__from"), F.lit(False))
    late = late.withColumn("verdict", F.when(is_full, "global").otherwise("user"))
    return done.select(*rows.columns, "verdict").unionByName(late.select(*rows.columns, "verdict"))


def _starts(segments: DataFrame, order: str, parts: int, user_limit: int, global_limit: int, seconds: int) -> DataFrame:
    """(__segment, start_sec, start_user): the true start of every segment."""
    packed = segments.groupBy("__segment").applyInArrow(_pack(order), _PACKED)
    length = max(1, math.isqrt(parts - 1) + 1)
    chunks = cut_lineage(packed.withColumn("__chunk", F.floor(F.col("__segment") / length).cast("int")), "packed")
    fold = _chain(user_limit, global_limit, seconds)
    starts = segments.sparkSession.createDataFrame([], "__chunk int, start_sec array<long>, start_user array<string>")
    todo, states = chunks, None
    while True:
        found = todo.groupBy("__chunk").cogroup(starts.groupBy("__chunk")).applyInArrow(fold, _STATES)
        redone = todo.select("__chunk").distinct()
        states = cut_lineage(found if states is None else states.join(redone, "__chunk", "left_anti").select(*found.columns).unionByName(found), "states")
        # One row per chunk, so the whole order of chunks is small.
        last = Window.orderBy("__chunk")
        ends = states.filter("__segment IS NULL")
        true = ends.select("__chunk", F.lag("start_sec").over(last).alias("start_sec"), F.lag("start_user").over(last).alias("start_user")).filter("size(start_sec) > 0")
        changed = true.join(starts.select("__chunk", F.col("start_sec").alias("s"), F.col("start_user").alias("u")), "__chunk", "full_outer").filter(
            ~(F.col("start_sec").eqNullSafe(F.col("s")) & F.col("start_user").eqNullSafe(F.col("u")))).select("__chunk")
        starts, changed = cut_lineage(true, "starts"), cut_lineage(changed, "changed")
        if changed.isEmpty():
            return states.filter("__segment IS NOT NULL").drop("__chunk")
        todo = chunks.join(changed, "__chunk", "left_semi").select(*chunks.columns)
