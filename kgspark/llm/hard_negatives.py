"""Hard negatives by slots of scores.

For an anchor every positive opens a window of scores below its own. The upper
limits of the windows cut the scores into disjoint slots; tasks keep the best of
each slot, and from the lowest slot upwards the best of a slot, followed by the
best below it, are the best at or below its limit: the answer of its window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.batches import written
from kgspark.llm.storage import locate

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Anchors of a block, those merged together, bytes of vectors a task holds, and of scores at once.
ANCHORS, MERGED, TILE_BYTES, SCORE_BYTES = 256, 16, 32 << 20, 16 << 20
#: Doubles are exact whole numbers up to here.
EXACT = 1 << 53
_TOP = "block long, anchor int, anchor_id long, slot int, score long, vec_id long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and vector of the rows that take part: none of the three null, no component null or not finite."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))


class Tile(NamedTuple):
    """Rows in the order of label and id, their vectors as whole numbers."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    @property
    def largest(self) -> int:
        return int(np.abs(self.vectors).max(initial=0))


def quantised(lists: pa.Array, scale: int) -> np.ndarray:
    """A row per list, shorter ones filled with 0."""
    size = np.diff(lists.offsets.to_numpy())
    values = np.floor(scale * lists.flatten().to_numpy())
    out = np.zeros((len(size), size.max(initial=0)))
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


def tile_of(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Tile:
    order = np.lexsort((ids, labels))
    return Tile(ids[order], labels[order], vectors[order])


def tiles(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[Tile]:
    held, size = [], 0

    def joined() -> Tile:
        wide = max(h[2].shape[1] for h in held)
        parts = [np.pad(h[2], ((0, 0), (0, wide - h[2].shape[1]))) for h in held]
        return tile_of(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate(parts))

    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = quantised(batch.column("vector"), scale)
        held.append((batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), vectors))
        size += vectors.nbytes
        if size >= TILE_BYTES:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def scores(anchors: np.ndarray, rows: np.ndarray, bound: int) -> np.ndarray:
    """Inner products, exact: by doubles where these suffice for sums up to ``bound``, else by whole numbers of any length."""
    wide = min(anchors.shape[1], rows.shape[1])
    a, b = anchors[:, :wide], rows[:, :wide]
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.dot(whole(a), whole(b).T).astype(np.int64) if wide else np.zeros((len(a), len(b)), np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k by score downwards, then id upwards; the whole of a tie at the end is looked at."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        among = np.flatnonzero(score >= least)
    else:
        among = np.arange(len(score))
    return among[np.lexsort((ids[among], -score[among]))[:k]]


class Block(NamedTuple):
    """Anchors that are scored together; ``limits`` are the scores of each one's positives, downwards, once known."""

    number: int
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    limits: dict[int, list[int]]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        for at in range(0, batch.num_rows, ANCHORS):
            part = batch.slice(at, ANCHORS)
            lists = [pa.array([part.column(c).to_pylist()], kind) for c, kind in (("vec_id", pa.list_(pa.int64())), ("label", pa.list_(pa.int64())), ("vector", pa.list_(pa.list_(pa.float64()))))]
            yield pa.RecordBatch.from_arrays([pa.array([task << 24 | seq], pa.int64()), *lists], names=["block", "ids", "labels", "vectors"])
            seq += 1


def _blocks(files: list[str], scale: int) -> Iterator[Block]:
    """Blocks of anchors from the shared folder, one at a time."""
    for uri in files:
        store, path = locate(unquote(uri))
        with store.open_input_file(path) as source:
            for batch in pq.ParquetFile(source).iter_batches(batch_size=1):
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i] for c in batch.schema.names}
                    limits: dict[int, list[int]] = {}
                    for anchor, score in zip(row["anchors"].as_py(), row["scores"].as_py()) if "anchors" in row else ():
                        limits.setdefault(anchor, []).append(score)
                    yield Block(row["block"].as_py(), row["ids"].values.to_numpy(), row["labels"].values.to_numpy(), quantised(row["vectors"].values, scale), limits)


def _same_label(k: int):
    def pick(tile: Tile, block: Block, i: int, score: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The best k rows of the anchor's label under other ids."""
        a, b = np.searchsorted(tile.labels, block.labels[i], "left"), np.searchsorted(tile.labels, block.labels[i], "right")
        at = a + np.flatnonzero(tile.ids[a:b] != block.ids[i])
        yield 0, at[best(score[at], tile.ids[at], k)]

    return pick


def windows(limits: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Least and greatest score of a negative for each positive: low * p <= 100 * n <= high * p; none from a negative p on."""
    return [(-(-low * p // 100), high * p // 100) for p in limits if p >= 0]


def _slots(k: int, low: int, high: int):
    def pick(tile: Tile, block: Block, i: int, score: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The best k rows of other labels in each slot; slot j lies above the next window's limit."""
        open_to = windows(sorted(block.limits.get(i, ()), reverse=True), low, high)
        if not open_to:
            return
        tops = [top for _, top in open_to]
        at = np.flatnonzero((tile.labels != block.labels[i]) & (score <= tops[0]) & (score >= open_to[-1][0]))
        slot = len(tops) - 1 - np.searchsorted(np.array(tops[::-1]), score[at], "left")
        for j in np.unique(slot).tolist():
            mine = at[slot == j]
            yield j, mine[best(score[mine], tile.ids[mine], k)]

    return pick


def _scored(files: list[str], scale: int, pick):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles(batches, scale):
            step = max(1, SCORE_BYTES // (8 * len(tile.ids)))
            for block in _blocks(files, scale):
                bound = int(np.abs(block.vectors).max(initial=0)) * tile.largest * block.vectors.shape[1]
                found = []
                for first in range(0, len(block.ids), step):
                    for i, score in enumerate(scores(block.vectors[first : first + step], tile.vectors, bound), first):
                        found += [(i, slot, score[at], tile.ids[at]) for slot, at in pick(tile, block, i, score)]
                size = [len(f[2]) for f in found]
                if sum(size):
                    anchor = np.repeat([f[0] for f in found], size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(anchor), block.number)), pa.array(anchor.astype(np.int32)), pa.array(block.ids[anchor]),
                         pa.array(np.repeat([f[1] for f in found], size).astype(np.int32)), pa.array(np.concatenate([f[2] for f in found])),
                         pa.array(np.concatenate([f[3] for f in found]))], names=["block", "anchor", "anchor_id", "slot", "score", "vec_id"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k over all tasks of each anchor and slot; Spark limits the ranks before it shuffles."""
    rank = F.row_number().over(Window.partitionBy("block", "anchor", "slot").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def suffix_merge(slots: dict[int, list[tuple[int, int]]], limits: list[int], k: int, low: int, high: int) -> list[list[tuple[int, int]]]:
    """The first k (score, id) of each window, from the best of each slot: slots merge from the lowest upwards.

    All scores of a slot exceed those below it, so a merge puts the slot first.
    """
    merged: list[tuple[int, int]] = []
    answers = []
    for j, (least, _) in reversed(list(enumerate(windows(limits, low, high)))):
        merged = (slots.get(j, []) + merged)[:k]
        answers.append([x for x in merged if x[0] >= least])
    return answers[::-1]


def _answers(k: int, low: int, high: int):
    def run(positives: pa.Table, slots: pa.Table) -> pa.Table:
        """Windows of a few anchors; at most POSITIVES times k rows of each reach this."""
        best_of: dict[int, dict[int, list]] = {}
        order = slots.sort_by([("anchor", "ascending"), ("slot", "ascending"), ("rank", "ascending")])
        for anchor, slot, score, vec_id in zip(*(order.column(c).to_pylist() for c in ("anchor", "slot", "score", "vec_id"))):
            best_of.setdefault(anchor, {}).setdefault(slot, []).append((score, vec_id))
        wanted: dict[int, list] = {}
        order = positives.sort_by([("anchor", "ascending"), ("rank", "ascending")])
        for anchor, anchor_id, score, vec_id in zip(*(order.column(c).to_pylist() for c in ("anchor", "anchor_id", "score", "vec_id"))):
            wanted.setdefault(anchor, []).append((anchor_id, score, vec_id))
        rows = []
        for anchor, mine in wanted.items():
            found = suffix_merge(best_of.get(anchor, {}), [p[1] for p in mine], k, low, high)
            for (anchor_id, score, vec_id), negatives in zip(mine, found):
                rows += [(anchor_id, vec_id, rank, n_id, score, n) for rank, (n, n_id) in enumerate(negatives, 1)]
        columns = list(zip(*rows)) or [()] * 6
        return pa.table([pa.array(c, pa.int32() if i == 2 else pa.int64()) for i, c in enumerate(columns)],
                        names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return run


def mine(vectors: DataFrame, anchors, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchors`` is a condition on vec_id and label. A score is the integer inner
    product of the components' floor(scale * x), a shorter vector filled with 0;
    higher ones come first, ties by vec_id. An anchor's positives are its first
    rows of the same label; each asks for the first rows of another label with
    low % to high % of its own score. Rows that are not ``usable`` take no part.
    Rows of the anchor's vec_id are neither positives nor negatives of it;
    repeated rows count as often as they stand. Other columns are not read.

    Anchors are scored against all rows in blocks: they are written packed into
    the shared folder, and a task, holding a tile of rows, opens one block at a
    time. Only the best of a tile are shuffled.
    """
    rows = usable(vectors)
    chosen = written(rows.where(anchors), "anchors")
    count = chosen.count()
    blocks = written(chosen.repartition(max(1, math.ceil(count / ANCHORS))).mapInArrow(
        _packed, "block long, ids array<long>, labels array<long>, vectors array<array<double>>"), "anchor-blocks")
    near = rows.mapInArrow(_scored(blocks.inputFiles(), scale, _same_label(positives)), _TOP)
    near = written(_first(near, positives), "positives")
    limits = near.groupBy("block").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("score").alias("scores"))
    ready = written(blocks.join(limits, "block"), "limited-blocks")
    slots = _first(rows.mapInArrow(_scored(ready.inputFiles(), scale, _slots(negatives, low, high)), _TOP), negatives)
    part = F.floor(F.col("anchor") / MERGED)
    slots, near = slots.withColumn("part", part), near.withColumn("part", part)
    return near.groupBy("block", "part").cogroup(slots.groupBy("block", "part")).applyInArrow(
        _answers(negatives, low, high), "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
