"""Which keys of a block occur elsewhere: a packed exchange between blocks of documents.

Every block sends its distinct keys, sorted and packed, to key ranges; a range
answers each block with those keys that more than one document holds, and in how
many. So a key costs its eight bytes once per block, not a row per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Text bytes of a block, and packed keys of a range, about.
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
_ROWS = "range int, block long, keys binary, df binary"


def ranges_for(keys: int) -> int:
    return max(16, math.ceil(12 * keys / RANGE_BYTES))


def range_bounds(ranges: int) -> np.ndarray:
    """First keys of all ranges but the first, of equal width."""
    return (np.arange(1, ranges, dtype=object) * (1 << 64) // ranges).astype(np.uint64)


def packer(column: str, ranges: int):
    """From rows (block, lists of keys, one list per document) to packed rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lists in zip(batch.column("block").to_pylist(), batch.column(column)):
                keys, df = np.unique(lists.values.flatten().to_numpy().view(np.uint64), return_counts=True)
                if not len(keys):
                    continue
                cuts = np.concatenate(([0], np.searchsorted(keys, range_bounds(ranges)), [len(keys)]))
                used = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used.astype(np.int32)), pa.array(np.full(len(used), block)),
                     pa.array([keys[cuts[r] : cuts[r + 1]].tobytes() for r in used], pa.binary()),
                     pa.array([df[cuts[r] : cuts[r + 1]].astype("<u4").tobytes() for r in used], pa.binary())], names=["range", "block", "keys", "df"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The keys of one range that several documents hold, for each block."""
    packed, counts = table.column("keys").to_pylist(), table.column("df").to_pylist()
    keys = np.frombuffer(b"".join(packed), np.uint64)
    df = np.frombuffer(b"".join(counts), "<u4").astype(np.int64)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    total = np.empty(len(keys), np.int64)
    total[order] = np.repeat(np.add.reduceat(df[order], first), np.diff(np.append(first, len(keys))))
    ends = np.cumsum([len(k) // 8 for k in packed])
    out_keys, out_df = [], []
    for a, b in zip(np.append(0, ends)[:-1].tolist(), ends.tolist()):
        shared = total[a:b] > 1
        out_keys.append(keys[a:b][shared].tobytes())
        out_df.append(np.minimum(total[a:b][shared], 0xFFFFFFFF).astype("<u4").tobytes())
    return pa.Table.from_arrays([table.column("block").combine_chunks(), pa.array(out_keys, pa.binary()), pa.array(out_df, pa.binary())], names=["block", "keys", "df"])


def shared_keys(blocks: DataFrame, column: str, total: int) -> DataFrame:
    """(block, keys, df): packed answers, several rows per block, of the keys in ``column`` that more than one document holds."""
    packed = blocks.select("block", column).mapInArrow(packer(column, ranges_for(total)), _ROWS)
    return packed.groupBy("range").applyInArrow(_answer, "block long, keys binary, df binary")


def merged(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a block's answers and their document counts."""
    keys = np.frombuffer(b"".join(answers.column("keys").to_pylist()), np.uint64)
    df = np.frombuffer(b"".join(answers.column("df").to_pylist()), "<u4")
    order = np.argsort(keys)
    return keys[order], df[order]


def counts_in(keys: np.ndarray, known: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Document count of each key, 0 where it is not among the known ones."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    spot = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[spot] == keys, df[spot], 0).astype(np.int64)
