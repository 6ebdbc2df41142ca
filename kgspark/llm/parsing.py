"""Locally consistent parsing of word sequences (recompression), vectorised over a batch of documents.

Rounds replace runs of one word, then pairs of neighbouring symbols, by new
symbols. A symbol's name is a 64-bit hash of what it replaces, so every task
gives equal parts equal names with no shared dictionary. Which pairs merge is
decided by one hash bit per symbol and round (left half, right half), so
neighbours alone decide, and equal passages parse alike in their interior.

For each symbol the parse also keeps its *extent*: the words that decide that
this symbol stands here. Wherever the same words occur again, the same symbol
occurs again. A symbol whose extent lies in a window is therefore in every
other occurrence of that window: the fact that candidates rest on.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from kgspark.llm.batches import mix

FAR = np.int64(1) << 40
_B = np.uint64(0xD6E8FEB86659FD93)


class Symbols(NamedTuple):
    name: np.ndarray   # uint64
    start: np.ndarray  # word positions in the batch, [start, stop)
    stop: np.ndarray
    lo: np.ndarray     # extent, [lo, hi)
    hi: np.ndarray


def _runs(words: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """Runs of an equal word become one symbol; first and last flag the ends of documents."""
    n = len(words)
    head = first.copy()
    head[1:] |= words[1:] != words[:-1]
    at = np.flatnonzero(head)
    stop = np.append(at[1:], n)
    length = stop - at
    name = words[at].copy()
    long_run = length > 1
    name[long_run] = mix(name[long_run] + length[long_run].astype(np.uint64) * _B, 1)
    starts_doc, ends_doc = first[at], last[stop - 1]
    lo = np.where(starts_doc, -FAR, at - 1)
    hi = np.where(ends_doc, FAR, stop + 1)
    return Symbols(name, at, stop, lo, hi), starts_doc, ends_doc


def _pairs(s: Symbols, first: np.ndarray, last: np.ndarray, turn: int, cap: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """One round of pair replacement; pairs longer than ``cap`` words are left alone."""
    left = (mix(s.name, 7 + turn) >> np.uint64(63)).astype(bool)
    length = s.stop - s.start
    small = length < cap
    n = len(s.name)
    lo, hi = s.lo.copy(), s.hi.copy()
    # What stands next decides whether a left symbol merges, what stands before decides for a right one.
    ahead = left & small
    back = ~left & small
    i = np.flatnonzero(ahead & ~last)
    lo[i], hi[i] = np.minimum(lo[i], s.lo[i + 1]), np.maximum(hi[i], s.hi[i + 1])
    hi[ahead & last] = FAR
    i = np.flatnonzero(back & ~first)
    lo[i], hi[i] = np.minimum(lo[i], s.lo[i - 1]), np.maximum(hi[i], s.hi[i - 1])
    lo[back & first] = -FAR
    pair = np.zeros(n, bool)
    if n > 1:
        pair[:-1] = left[:-1] & ~left[1:] & ~last[:-1] & (length[:-1] + length[1:] <= cap)
    keep = np.ones(n, bool)
    keep[1:] = ~pair[:-1]
    p = np.flatnonzero(pair)
    name, stop = s.name.copy(), s.stop.copy()
    name[p] = mix(s.name[p] * _B + mix(s.name[p + 1], 3), 5)
    stop[p] = s.stop[p + 1]
    lo[p] = np.minimum(s.lo[p], s.lo[p + 1])
    hi[p] = np.maximum(s.hi[p], s.hi[p + 1])
    last = last.copy()
    last[p] = last[p + 1]
    return Symbols(name[keep], s.start[keep], stop[keep], lo[keep], hi[keep]), first[keep], last[keep]


def parse(words: np.ndarray, starts: np.ndarray, rounds: int, cap: int) -> Symbols:
    """Symbols of a batch: ``words`` are 64-bit word names, ``starts`` the first word of each non-empty document."""
    first = np.zeros(len(words), bool)
    first[starts] = True
    last = np.zeros(len(words), bool)
    last[np.append(starts[1:], len(words)) - 1] = True
    s, first, last = _runs(words, first, last)
    for turn in range(rounds):
        s, first, last = _pairs(s, first, last, turn, cap)
    return s
