"""String and vector similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kgspark.functions.text import words


def _codes(values: pd.Series, width: int) -> np.ndarray:
    """Strings as a padded matrix of code points (0 = no character)."""
    fixed_width = np.array(values.to_numpy(), dtype=f"<U{width}")
    return fixed_width.view(np.uint32).reshape(len(values), width)


@F.pandas_udf(DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro-Winkler with the prefix bonus always applied.

    One pass over character positions, each step handling a whole Arrow batch.
    """
    a, b = a.fillna(""), b.fillna("")
    la, lb = a.str.len().to_numpy(), b.str.len().to_numpy()
    n, wa, wb = len(a), int(max(la.max(initial=0), 1)), int(max(lb.max(initial=0), 1))
    ca, cb = _codes(a, wa), _codes(b, wb)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    taken = np.zeros((n, wb), dtype=bool)
    picked = np.zeros((n, wa), dtype=bool)
    column = np.arange(wb)
    for i in range(wa):
        ok = (cb == ca[:, i : i + 1]) & ~taken & (i < la)[:, None] & (column < lb[:, None])
        ok &= np.abs(column[None, :] - i) <= window[:, None]
        hit = ok.any(axis=1)
        taken[np.flatnonzero(hit), ok.argmax(axis=1)[hit]] = True
        picked[:, i] = hit
    matches = picked.sum(axis=1)
    # Matched characters of both sides, in order, to count those out of place.
    row_a, pos_a = np.nonzero(picked)
    row_b, pos_b = np.nonzero(taken)
    moved = np.bincount(row_a, weights=ca[row_a, pos_a] != cb[row_b, pos_b], minlength=n)
    m = np.maximum(matches, 1).astype(float)
    jaro = (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved / 2) / m) / 3
    jaro = np.where(matches == 0, 0.0, jaro)
    head = min(4, wa, wb)
    same = (ca[:, :head] == cb[:, :head]) & (ca[:, :head] != 0)
    prefix = np.cumprod(same, axis=1).sum(axis=1)
    score = np.where(matches == 0, 0.0, jaro + prefix * 0.1 * (1 - jaro))
    exact = a.to_numpy() == b.to_numpy()
    return pd.Series(np.where(exact, 1.0, score))


@F.pandas_udf(DoubleType())
def _indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * LCS / (len a + len b), batched over rows."""
    a, b = a.fillna(""), b.fillna("")
    la, lb = a.str.len().to_numpy(), b.str.len().to_numpy()
    n, wa, wb = len(a), int(max(la.max(initial=0), 1)), int(max(lb.max(initial=0), 1))
    ca, cb = _codes(a, wa), _codes(b, wb)
    prev = np.zeros((n, wb + 1), dtype=np.int32)
    for i in range(wa):
        cur = np.zeros_like(prev)
        equal = (cb == ca[:, i : i + 1]) & (ca[:, i : i + 1] != 0)
        for j in range(wb):
            cur[:, j + 1] = np.where(equal[:, j], prev[:, j] + 1, np.maximum(prev[:, j + 1], cur[:, j]))
        prev = cur
    total = la + lb
    return pd.Series(np.where(total == 0, 100.0, 200.0 * prev[:, wb] / np.maximum(total, 1)))


# Declared non-deterministic so that a filter on a score is not pushed below the
# step that removes duplicate pairs, which would score every pair twice.
jaro_winkler = _jaro_winkler.asNondeterministic()
indel_ratio = _indel_ratio.asNondeterministic()


def trigrams(c: Column) -> Column:
    """Distinct three-character pieces of each padded lower-case word."""
    clean = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    padded = F.transform(words(clean), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    pieces = F.transform(
        padded,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(pieces))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(0.0)).otherwise(shared / total)


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])
