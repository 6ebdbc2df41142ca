"""Removal of passages that already stand in a document with a smaller id (substring deduplication by recompression).

1. Every text is parsed by rounds of run and pair replacement (`parsing`), whose
   symbols are named alike in all tasks. One row per document holds its symbols.
2. Blocks of documents ask, packed, which of their symbols other documents share.
3. A window can only be repeated if every symbol whose extent lies in it is
   shared. Only such windows (and those too uniform to hold a symbol) go on.
4. They meet by a 128-bit name of their exact words, packed as well; the smallest
   document of each wins, and later documents lose the words it covers.

Texts with the very same words as a smaller document are settled by a grouped
minimum and take no part in 3 and 4. A passage that a third of all documents hold
is one entry per block, and nothing is paired. Texts are shuffled once, to meet
their shared symbols; after that only candidates move.

Defined cases: null or empty text has no words and keeps the hash of nothing. A
text below the window length loses nothing. Rows that repeat a doc_id with one
text get one result each; rows with one doc_id never remove from one another. A
null doc_id neither loses words nor removes any. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.batches import keyed, mix, powers, text_chunks, words_in, written
from kgspark.llm.exchange import BLOCK_BYTES, counts_in, merged, range_bounds, ranges_for, shared_keys
from kgspark.llm.parsing import Symbols, parse

WINDOW = 50
ROUNDS, CAP = 7, 14


def _usable(s: Symbols, window: int) -> np.ndarray:
    return s.hi - s.lo <= window


def _parsed(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, Symbols]:
    words, counts = (w := words_in(texts)).names, w.counts
    ends = np.cumsum(counts)
    begins = ends - counts
    return words, begins, ends, (parse(words, begins[counts > 0], ROUNDS, CAP) if len(words) else Symbols(*[np.empty(0, np.int64)] * 5))


def _windows_with(lo: np.ndarray, hi: np.ndarray, n: int, window: int) -> np.ndarray:
    """For each word, whether the window that starts there contains one of the extents."""
    step = np.bincount(np.maximum(hi - window, 0), minlength=n + 2)[: n + 2] - np.bincount(lo + 1, minlength=n + 2)[: n + 2]
    return np.cumsum(step)[:n] > 0


_BLOCKS = ("block long, doc_id array<long>, text_key array<long>, n_words array<long>, sha array<string>, blind array<boolean>, "
           "symbols array<array<long>>")


def symbol_blocks(window: int):
    """One row per block of documents: their ids, sizes and digests, and the distinct usable symbols of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, size = TaskContext.get().partitionId(), 0, 0
        held: list[list] = [[] for _ in range(6)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64())]

        def flush() -> pa.RecordBatch:
            columns = [pa.array([task << 24 | seq], pa.int64()), *(pa.array([h], pa.list_(k)) for h, k in zip(held, kinds))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "doc_id", "text_key", "n_words", "sha", "blind", "symbols"])

        for part, texts in text_chunks(batches):
            words, begins, ends, s = _parsed(texts)
            n = len(words)
            ok = _usable(s, window)
            seen = _windows_with(s.lo[ok], s.hi[ok], n, window) if n else np.empty(0, bool)
            name, at = s.name[ok].view(np.int64) if n else s.name, s.start[ok]
            cut = np.searchsorted(at, np.append(begins, n))
            for i, (text, doc_id, key) in enumerate(zip(texts, part.column("doc_id").to_pylist(), part.column("text_key").to_pylist())):
                last = ends[i] - window + 1
                known = doc_id is not None
                row = (doc_id, key, int(ends[i] - begins[i]), hashlib.sha256(b" ".join(text.split()) if text else b"").hexdigest(),
                       bool(known and last > begins[i] and not seen[begins[i] : last].all()),
                       np.unique(name[cut[i] : np.searchsorted(at, ends[i])]) if n and known else name[:0])
                for h, x in zip(held, row):
                    h.append(x)
                size += len(text or b"")
            if size >= BLOCK_BYTES:
                yield flush()
                held, size, seq = [[] for _ in range(6)], 0, seq + 1
        if held[0]:
            yield flush()

    return run


def _holders(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block that hold shared symbols (or windows without symbols), with those symbols."""
    known, df = merged(right)
    rows: list[tuple] = []
    for c in range(left.num_rows):
        row = {n: left.column(n)[c] for n in ("doc_id", "text_key", "blind", "symbols")}
        lists = row["symbols"].values
        keys = lists.flatten().to_numpy().view(np.uint64)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        found = counts_in(keys, known, df) > 1
        for doc_id, text_key, blind, a, b in zip(row["doc_id"].as_py(), row["text_key"].as_py(), row["blind"].as_py(), np.append(0, ends)[:-1].tolist(), ends.tolist()):
            mine = keys[a:b][found[a:b]]
            if len(mine) or blind:
                rows.append((doc_id, text_key, mine.view(np.int64)))
    columns = list(zip(*rows)) or [[], [], []]
    return pa.Table.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int64()))],
                                names=["doc_id", "text_key", "shared"])


def window_names(words: np.ndarray, window: int, salt: int) -> np.ndarray:
    """A 64-bit name of the words of each window, from one pass of prefix sums modulo 2**64."""
    base = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)[salt]
    up, down = powers(base, len(words)), powers(pow(base, -1, 1 << 64), len(words))
    total = np.append(np.uint64(0), np.cumsum(mix(words, 11 + salt) * up, dtype=np.uint64))
    return mix((total[window:] - total[:-window]) * down[: len(words) - window + 1], 13 + salt)


#: Text bytes of a block of candidates.
CANDIDATE_BYTES = 4 << 20
_CANDIDATES = "block long, doc_id array<long>, text_key array<long>, text array<string>, shared array<array<long>>"


def _candidate_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    names = ["doc_id", "text_key", "text", "shared"]
    seq = 0
    for part, _ in text_chunks(batches, limit=CANDIDATE_BYTES):
        columns = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(n)) for n in names]
        yield pa.RecordBatch.from_arrays([pa.array([task << 24 | seq], pa.int64()), *columns], names=["block", *names])
        seq += 1


class _Windows(NamedTuple):
    """Candidate windows of a block: document, first word, name; then each distinct name with its smallest document."""

    texts: list
    doc: np.ndarray
    start: np.ndarray
    number: np.ndarray
    h1: np.ndarray
    h2: np.ndarray
    first: np.ndarray


def _windows(texts: list, doc_ids: np.ndarray, shared: pa.Array, window: int) -> _Windows:
    words, begins, ends, s = _parsed(texts)
    n = len(words)
    none = np.empty(0, np.int64)
    if n < window:
        return _Windows(texts, none, none, none, none.astype(np.uint64), none.astype(np.uint64), none)
    ok = _usable(s, window)
    lo, hi, name, at = s.lo[ok], s.hi[ok], s.name[ok].view(np.int64), s.start[ok]
    alone = np.ones(len(lo), bool)
    for i in range(len(texts)):
        a, b = np.searchsorted(at, (begins[i], ends[i]))
        known = shared[i].values
        if known is not None and len(known):
            alone[a:b] = ~np.isin(name[a:b], known.to_numpy())
    hopeless = _windows_with(lo[alone], hi[alone], n, window)
    doc = np.repeat(np.arange(len(texts)), ends - begins)
    start = np.arange(n - window + 1)
    start = start[(doc[: n - window + 1] == doc[window - 1 :]) & ~hopeless[: n - window + 1]]
    h1, h2 = (window_names(words, window, k)[start] for k in (0, 1))
    order = np.lexsort((h2, h1))
    new = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])) if len(order) else np.empty(0, bool)
    at = np.flatnonzero(new)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    d = doc[start]
    first = np.minimum.reduceat(doc_ids[d][order], at) if len(at) else none
    return _Windows(texts, d, start - begins[d], number, h1[order][at], h2[order][at], first)


def _row(column: pa.Array, i: int) -> pa.Array:
    return column[i].values


def _block(row_of, window: int) -> _Windows:
    return _windows(row_of("text").cast(pa.binary()).to_pylist(), row_of("doc_id").to_numpy(), row_of("shared"), window)


def _offers(window: int, ranges: int):
    """Packed (range, block): the distinct windows of a block, each with its smallest document there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                w = _block(lambda n: _row(batch.column(n), i), window)  # noqa: B023
                if not len(w.h1):
                    continue
                cuts = np.concatenate(([0], np.searchsorted(w.h1, range_bounds(ranges)), [len(w.h1)]))
                used = np.flatnonzero(np.diff(cuts))
                packed = [[x[cuts[r] : cuts[r + 1]].tobytes() for r in used] for x in (w.h1, w.h2, w.first)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), block)), *(pa.array(x, pa.binary()) for x in packed)],
                    names=["range", "block", "h1", "h2", "first"])

    return run


def _owners(table: pa.Table) -> pa.Table:
    """For each block, the windows of a range that stand in a smaller document than any of the block's, with that document."""
    raw = {n: table.column(n).to_pylist() for n in ("h1", "h2", "first")}
    h1, h2 = (np.frombuffer(b"".join(raw[n]), np.uint64) for n in ("h1", "h2"))
    first = np.frombuffer(b"".join(raw["first"]), np.int64)
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    least = np.empty(len(h1), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(first[order], at), np.diff(np.append(at, len(h1))))
    out: list[list] = [[], [], []]
    ends = np.cumsum([len(x) // 8 for x in raw["h1"]])
    for x, y in zip(np.append(0, ends)[:-1].tolist(), ends.tolist()):
        won = np.flatnonzero(least[x:y] < first[x:y]) + x
        for o, values in zip(out, (h1, h2, least)):
            o.append(values[won].tobytes())
    return pa.Table.from_arrays([table.column("block").combine_chunks(), *(pa.array(o, pa.binary()) for o in out)], names=["block", "h1", "h2", "first"])


_CHANGED = "doc_id long, text_key long, n_removed long, kept_text string, spans array<array<int>>"


def _removals(window: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        h1, h2 = (np.frombuffer(b"".join(right.column(n).to_pylist()), np.uint64) for n in ("h1", "h2"))
        owner = np.frombuffer(b"".join(right.column("first").to_pylist()), np.int64)
        order = np.lexsort((h2, h1))
        h1, h2, owner = h1[order], h2[order], owner[order]
        rows: list[tuple] = []
        for i in range(left.num_rows):
            row_of = lambda n: left.column(n)[i].values  # noqa: B023, E731
            doc_ids, keys = row_of("doc_id").to_numpy(), row_of("text_key").to_pylist()
            w = _block(row_of, window)
            least = w.first.copy()
            # Answers are in the order of the block's own windows, both sorted by name.
            spot = np.flatnonzero(np.isin(w.h1, h1))
            back = np.searchsorted(h1, w.h1[spot])
            for _ in range(4):  # equal first halves are next to impossible, but then the second half tells
                differ = (back < len(h1)) & (h1[np.minimum(back, len(h1) - 1)] == w.h1[spot]) & (h2[np.minimum(back, len(h1) - 1)] != w.h2[spot]) if len(h1) else np.zeros(0, bool)
                back = back + differ
            good = (back < len(h1)) if len(h1) else np.zeros(0, bool)
            good[good] = (h1[back[good]] == w.h1[spot[good]]) & (h2[back[good]] == w.h2[spot[good]])
            least[spot[good]] = owner[back[good]]
            gone = doc_ids[w.doc] > least[w.number]
            for d in np.unique(w.doc[gone]).tolist():
                words = w.texts[d].split()
                step = np.zeros(len(words) + 1, np.int32)
                at = w.start[gone & (w.doc == d)]
                step[at] += 1
                step[at + window] -= 1
                lost = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], lost.astype(np.int8), [0])))).astype(np.int32)
                rows.append((int(doc_ids[d]), keys[d], int(lost.sum()), b" ".join(x for x, g in zip(words, lost) if not g).decode(), edge.reshape(-1, 2).tolist()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())))
        columns = list(zip(*rows)) or [[]] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in _CHANGED.split(", ")])

    return run


def deduplicate(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(all documents, changed documents).

    The first has doc_id, text_key, n_words, sha (of all words) and ``copy``: a
    smaller document has the very same words, so all go. The second has, for the
    other documents that lose words, n_removed, kept_text and the removed word
    spans [start, stop).
    """
    docs = keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    blocks = written(docs.mapInArrow(symbol_blocks(window), _BLOCKS), "symbols")
    every = blocks.select(F.inline(F.arrays_zip("doc_id", "text_key", "n_words", "sha")))
    first = every.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("latest"))
    every = every.join(first.where("first < latest").select("sha", "first"), "sha", "left")
    every = written(every.select("doc_id", "text_key", "n_words", "sha", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("copy")), "sizes")
    total = blocks.agg(F.sum(F.aggregate("symbols", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x)))).first()[0] or 0
    answers = shared_keys(blocks, "symbols", total)
    holders = blocks.select("block", "doc_id", "text_key", "blind", "symbols").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _holders, "doc_id long, text_key long, shared array<long>")
    copies = every.where("copy").select("doc_id", "text_key")
    holders = holders.join(copies, ["doc_id", "text_key"], "left_anti").dropDuplicates(["doc_id", "text_key"])
    candidates = written(docs.join(holders, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "shared").mapInArrow(_candidate_blocks, _CANDIDATES), "candidates")
    words = candidates.agg(F.sum(F.aggregate("text", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)))).first()[0] or 0
    ranges = ranges_for(words // 4)
    offers = candidates.mapInArrow(_offers(window, ranges), "range int, block long, h1 binary, h2 binary, first binary")
    owners = offers.groupBy("range").applyInArrow(_owners, "block long, h1 binary, h2 binary, first binary")
    changed = candidates.groupBy("block").cogroup(owners.groupBy("block")).applyInArrow(_removals(window), _CHANGED)
    return every, changed


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words, one row per input row."""
    every, changed = deduplicate(docs)
    changed = changed.select("doc_id", "text_key", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept")).dropDuplicates(["doc_id", "text_key"])
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(changed, ["doc_id", "text_key"], "left").select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("bigint"))).alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))
