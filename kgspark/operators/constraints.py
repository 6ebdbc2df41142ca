"""Splits batches by the constraints of their tables: valid rows, and rejected ones with the reason.

Tables are taken parents first. A row must pass its checks, find its parents
among the stored rows or the accepted ones of the same batch, and be the first
accepted row of each of its unique keys; so a refused parent refuses its
children, theirs, and so on, over tables and inside a table that refers to itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.session import cut_lineage


@dataclass(frozen=True)
class Reference:
    """``columns`` must stand in ``parent`` as ``parent_columns``; a null in them refers to nothing."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Rules:
    """Constraints of one table. ``order`` names the columns, together unique, that say which row came first.

    A check that is null holds, and unique keys with a null in them do not
    clash, as in SQL.
    """

    table: str
    order: tuple[str, ...]
    checks: Mapping[str, Column] = field(default_factory=dict)
    unique: Sequence[tuple[str, ...]] = ()
    references: Sequence[Reference] = ()


def _mark(rows: DataFrame, reason: Column) -> DataFrame:
    """Gives rows without a reason the one that ``reason`` holds (null: none)."""
    return rows.withColumn("reason", F.coalesce("reason", reason))


def _present(rows: DataFrame, columns: Sequence[str], known: DataFrame, flag: str) -> DataFrame:
    """``rows`` with a column ``flag``: whether their values of ``columns`` are among those of ``known``."""
    keys = known.toDF(*[f"__{flag}_{i}" for i in range(len(columns))]).dropna().distinct().withColumn(flag, F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__{flag}_{i}") for i, c in enumerate(columns)])
    return rows.join(keys, same, "left").drop(*[f"__{flag}_{i}" for i in range(len(columns))])


def _all_set(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _orphans(rows: DataFrame, ref: Reference, parents: DataFrame) -> DataFrame:
    found = _present(rows, ref.columns, parents.select(*ref.parent_columns), "__found")
    lost = _all_set(ref.columns) & F.col("__found").isNull()
    return _mark(found, F.when(lost, f"foreign key {', '.join(ref.columns)}")).drop("__found")


def _repeats(rows: DataFrame, key: Sequence[str], order: Sequence[str], stored: Optional[DataFrame]) -> DataFrame:
    """Marks rows whose key is stored, or held by an earlier row that is still without a reason."""
    reason = F.lit(f"unique {', '.join(key)}")
    if stored is not None:
        known = _present(rows, key, stored.select(*key), "__stored")
        rows = _mark(known, F.when(F.col("__stored"), reason)).drop("__stored")
    # A minimum per key with map-side partials: a key with very many rows is never gathered.
    first = rows.filter(F.col("reason").isNull() & _all_set(key)).groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)]).agg(F.min(F.struct(*order)).alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__k{i}") for i, c in enumerate(key)])
    judged = _mark(rows.join(first, same, "left"), F.when(F.struct(*order) > F.col("__first"), reason))
    return judged.drop("__first", *[f"__k{i}" for i in range(len(key))])


def _cascade(rows: DataFrame, ref: Reference, stored: Optional[DataFrame]) -> DataFrame:
    """References inside one table: rows lose their parent, then their children theirs, until nothing changes."""
    while True:
        parents = rows.filter(F.col("reason").isNull()).select(*ref.parent_columns)
        parents = parents if stored is None else parents.unionByName(stored.select(*ref.parent_columns))
        now = cut_lineage(_orphans(rows, ref, parents), "cascade")
        if now.filter(F.col("reason").isNull()).count() == rows.filter(F.col("reason").isNull()).count():
            return now
        rows = now


def split(batch: Mapping[str, DataFrame], stored: Mapping[str, DataFrame], rules: Sequence[Rules]) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Accepted rows, and rejected rows with ``reason``, of each table of ``rules`` (parents before children).

    The first violated constraint is the reason: a check, then a reference, then
    a unique key. A row that only loses its parent inside its own table has held
    its keys until then, so no later row takes its place in this batch.
    """
    out: dict[str, tuple[DataFrame, DataFrame]] = {}
    for r in rules:
        rows = batch[r.table].withColumn("reason", F.lit(None).cast("string"))
        for name, holds in r.checks.items():
            rows = _mark(rows, F.when(~holds, f"check {name}"))
        for ref in r.references:
            if ref.parent != r.table:
                known = [d.select(*ref.parent_columns) for d in (out[ref.parent][0] if ref.parent in out else None, stored.get(ref.parent)) if d is not None]
                rows = _orphans(rows, ref, reduce(DataFrame.unionByName, known))
        for key in r.unique:
            rows = _repeats(cut_lineage(rows, f"split-{r.table}"), key, r.order, stored.get(r.table))
        rows = cut_lineage(rows, f"split-{r.table}")
        for ref in r.references:
            if ref.parent == r.table:
                rows = _cascade(rows, ref, stored.get(r.table))
        out[r.table] = rows.filter(F.col("reason").isNull()).drop("reason"), rows.filter(F.col("reason").isNotNull())
    return out
