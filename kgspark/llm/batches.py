"""Helpers for Arrow-batched text work."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark import session

#: Text handled at once inside a task; a longer document is handled alone.
CHUNK_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("*",)))


#: A table written once to the cluster's shared folder and read back, and its deletion.
written, erase = session.cut_lineage, session.erase


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores as make it differ from all that are taken."""
    have = {c.lower() for c in taken}
    return [next(n for n in (name + "_" * k for k in range(len(have) + 1)) if n not in have) for name in names]


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches with at most ``limit`` bytes of text each (one row at least), and their texts as bytes (null: None)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
            part = batch.slice(at, stop - at)
            yield part, part.column(column).cast(pa.binary()).to_pylist()
            at = stop


class Words(NamedTuple):
    """Words of several texts: a 64-bit name each, their byte range in ``data``, and how many each text has."""

    names: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    counts: np.ndarray
    data: bytes

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.stops[i]]


#: Bytes whose words are named at once.
BLOCK = 1 << 20
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of an odd base modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, np.uint64)
        have[0] = 1
        np.cumprod(have, dtype=np.uint64, out=have)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ np.uint64(salt * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


_BYTES = mix(np.arange(1, 257, dtype=np.uint64), 99)


def words_in(texts: list, marks: bool = False) -> Words:
    """Words ``[^\x20\x09-\x0D]+`` of the texts (bytes or None). A name is a tabulated polynomial of the word's bytes, from prefix sums.

    With ``marks``, a comma or full stop that ends a word after a-z is a word of its own.
    """
    data = b" ".join(t or b"" for t in texts) + b" "
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate(([True], _SPACE[raw]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, stops = edges[0::2], edges[1::2]
    if marks:
        last, before = raw[stops - 1], raw[np.maximum(stops - 2, 0)]
        cut = stops[((last == 44) | (last == 46)) & (before >= 97) & (before <= 122) & (stops - starts > 1)] - 1
        starts, stops = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((stops, cut)))
    size = np.array([len(t or b"") + 1 for t in texts], np.int64)
    counts = np.diff(np.append(0, np.searchsorted(starts, np.cumsum(size))))
    names = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(stops, starts[at] + BLOCK)))
        low, n = starts[at], stops[upto - 1] - starts[at]
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[raw[low : low + n]] * powers(_BASE, n), dtype=np.uint64, out=total[1:])
        a, b = starts[at:upto] - low, stops[at:upto] - low
        names[at:upto] = mix((total[b] - total[a]) * powers(pow(_BASE, -1, 1 << 64), n)[a], 1)
        at = upto
    return Words(names, starts, stops, counts, data)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def keyed(df: DataFrame) -> DataFrame:
    """Adds ``text_key``, so that rows with one doc_id but different texts stay apart."""
    return df.withColumn("text_key", F.xxhash64("text"))
