"""Benchmark decontamination: an FM-index per shard of training text, searched for all test phrases at once.

A task gathers documents into shards of bounded size. Words that no test item
holds cannot be part of a match, so the index covers the maximal stretches of
test words only; stretches below the shortest phrase go too. Backward search
through wavelet ranks gives each phrase's rows, sampled suffix positions locate
its occurrences, and overlapping occurrences merge into removal spans.

Test items are taken in blocks of bounded size (``BLOCK_BYTES`` of text each,
by hash), one block per pass; texts flow from pass to pass within their task,
so nothing is shuffled and no hot document or phrase gathers anywhere.

Defined cases: null and empty texts have no words and no hits; items without
words have no phrases. Repeated rows are judged each. Several items with one
text all count. A null item_id takes part in hits but not in the list of items.
Empty tables give no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from kgspark.llm.batches import text_chunks, words_in
from kgspark.llm.fm_index import FMIndex

WINDOW = 13
BLOCK_BYTES = 8 << 20
#: Words of a shard (before words that no item holds are left out).
SHARD_WORDS = 1_000_000
#: A-Z to a-z, digits and bytes from 0x80 kept, all else a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: bytes | None) -> bytes | None:
    return text.translate(_FOLD) if text else None


class Phrases(NamedTuple):
    """Sorted names of all their words, distinct phrases as rows of word numbers (from 1), and the items of each."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    lengths: np.ndarray
    items: list[list]


def phrases(items: list[tuple], window: int) -> Phrases:
    owners: dict[tuple, set] = {}
    found = words_in([folded(text.encode()) if text else None for _, text in items])
    vocabulary, number = np.unique(found.names, return_inverse=True)
    ends = np.cumsum(found.counts)
    for (item_id, _), n, end in zip(items, found.counts, ends):
        ids = (number[end - n : end] + 1).tolist()
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            owners.setdefault(tuple(ids[i : i + window]), set()).add(item_id)
    patterns = np.zeros((len(owners), window), np.int64)
    lengths = np.zeros(len(owners), np.int64)
    for k, p in enumerate(owners):
        patterns[k, : len(p)], lengths[k] = p, len(p)
    return Phrases(vocabulary, patterns, lengths, [sorted(o - {None}) for o in owners.values()])


def _stretches(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Text of the index (stretches of known words, each followed by 0) and the word position of each of its symbols."""
    known = np.concatenate(([False], ids > 0, [False]))
    edge = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
    edge = edge[edge[:, 1] - edge[:, 0] >= shortest]
    size = edge[:, 1] - edge[:, 0] + 1
    ends = np.cumsum(size)
    where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(edge[:, 0] - (ends - size), size)
    text = ids[np.minimum(where, len(ids) - 1)] if len(where) else np.empty(0, np.int64)
    text[ends - 1] = 0
    return text, where


def _shard(ids: np.ndarray, begins: np.ndarray, wanted: Phrases) -> tuple[np.ndarray, list[set]]:
    """Words hit, and the items met in each document, for one shard of documents (ids with a 0 after each)."""
    hit = np.zeros(len(ids) + 1, np.int64)
    met: list[set] = [set() for _ in begins]
    text, where = _stretches(ids, int(wanted.lengths.min(initial=1 << 30)))
    if len(text):
        index = FMIndex(text)
        lo, hi = index.search(wanted.patterns, wanted.lengths)
        found = np.flatnonzero(hi > lo)
        times = (hi - lo)[found]
        rows = np.arange(times.sum()) + np.repeat(lo[found] - (np.cumsum(times) - times), times)
        phrase = np.repeat(found, times)
        at = where[index.locate(rows)]
        np.add.at(hit, at, 1)
        np.add.at(hit, at + wanted.lengths[phrase], -1)
        doc = np.searchsorted(begins, at, side="right") - 1
        for d, p in set(zip(doc.tolist(), phrase.tolist())):
            met[d].update(wanted.items[p])
    return np.cumsum(hit[:-1]) > 0, met


def _pass(wanted: Phrases, last: bool):
    """One block of phrases against all documents; the last pass drops the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = wanted.vocabulary if len(wanted.vocabulary) else np.zeros(1, np.uint64)
        parts: list[pa.RecordBatch] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            batch = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            n_ids = np.concatenate(lengths)
            begins = np.cumsum(n_ids) - n_ids
            hit, met = _shard(np.concatenate(held), begins, wanted)
            spans, items = [], []
            old = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            for (had, knew), a, n, ids in zip(old, begins.tolist(), n_ids.tolist(), met):
                mine = hit[a : a + n - 1].copy()
                for x, y in had:
                    mine[x:y] = True
                spans.append(np.flatnonzero(np.diff(np.concatenate(([0], mine.astype(np.int8), [0])))).reshape(-1, 2).tolist())
                items.append(sorted(ids.union(knew)))
            new = {"n_words": pa.array(n_ids - 1), "spans": pa.array(spans, pa.list_(pa.list_(pa.int64()))), "items": pa.array(items, batch.column("items").type)}
            names = [c for c in batch.schema.names if not (last and c == "text")]
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)

        for part, texts in text_chunks(batches):
            found = words_in([folded(t) for t in texts])
            number = np.minimum(np.searchsorted(vocabulary, found.names), len(vocabulary) - 1)
            ends = np.cumsum(found.counts)
            # One 0 behind each document keeps matches within it.
            held.append(np.insert(np.where(vocabulary[number] == found.names, number + 1, 0), ends, 0))
            lengths.append(found.counts + 1)
            size += len(held[-1])
            parts.append(part)
            if size >= SHARD_WORDS:
                yield from flush()
                parts, held, lengths, size = [], [], [], 0
        if parts:
            yield from flush()

    return run


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its text, with n_words, spans (hit words as [start, stop)) and items (their ids, sorted)."""
    benchmark = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = docs.drop("n_words", "spans", "items").withColumns({
        "n_words": F.lit(0).cast("bigint"), "spans": F.array().cast("array<array<bigint>>"), "items": F.array().cast(ArrayType(benchmark.schema["item_id"].dataType))})
    for b in range(blocks):
        wanted = phrases([(r[0], r[1]) for r in benchmark.where(place == b).collect()], window)
        last = b == blocks - 1
        out = out.mapInArrow(_pass(wanted, last), StructType([f for f in out.schema if not (last and f.name == "text")]))
    return out



def report(found: DataFrame) -> DataFrame:
    """Counts and digests of what ``find`` gives."""
    hits = F.coalesce(F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0]), F.lit(0).cast("bigint"))
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    # The row itself goes through the passes, so nothing has to be joined back.
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    found = find(row, benchmark)
    hits = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return found.where(~((hits > 0) & (20 * hits >= F.col("n_words")))).select("row.*")
