"""Upserts, merges and deletes as whole-table rewrites.

Each takes the stored table and a batch and returns the new table. Conflicts
inside a batch are settled by the row order column, so results do not depend
on partitioning. Everything is an aggregation or an equality join on the key.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.session import run_dir


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Stored rows win; of several new rows with one key the first is inserted."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*")
    return old.unionByName(first.join(old, list(keys), "left_anti"), allowMissingColumns=True)


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A batch row replaces the stored row of its key, whatever its order value; within the batch the greatest order value wins."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__new", order)).alias("r")).select(*keys, "r.*")


def upsert_increment(old: DataFrame, new: DataFrame, keys: Sequence[str], count: str, keep_first: str, order: str) -> DataFrame:
    """Counts add up (one per new row); ``keep_first`` keeps the oldest value of the key."""
    cols = [*keys, count, keep_first, order]
    both = old.select(*cols, F.lit(0).alias("__new")).unionByName(new.select(*cols, F.lit(1).alias("__new")))
    return both.groupBy(*keys).agg(
        F.sum(count).alias(count), F.min_by(keep_first, F.struct("__new", order)).alias(keep_first))


def coalesce_merge(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_when_null: Sequence[str], order: Optional[str] = None) -> DataFrame:
    """New values replace old ones, except that nulls in ``keep_when_null`` leave the old value.

    Rows of one key in the batch are settled first, as if they came one by one in
    the order of ``order`` (of all their values where it is not given).
    """
    rest = [c for c in old.columns if c not in keys]
    by = F.col(order) if order else F.struct(*rest)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), by)) if c in keep_when_null else F.max_by(F.struct(c), by)[c]
    new = new.groupBy(*keys).agg(*[last(c).alias(c) for c in rest])
    o, n = old.alias("o"), new.alias("n")
    cond = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    in_new = F.col(f"n.{keys[0]}").isNotNull()

    def pick(c: str) -> Column:
        if c in keys or c in keep_when_null:
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c)
        return F.when(in_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    return o.join(n, cond, "full_outer").select(*[pick(c) for c in old.columns])


def replace_source(old: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """All rows of the sources present in ``new`` are replaced by its rows."""
    return old.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def fill_when_empty(col: Column, value: Column) -> Column:
    return F.when(col.isNull() | (col == ""), value).otherwise(col)


def merge_distinct(a: Column, b: Column) -> Column:
    """Union of two arrays without repeats, sorted."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none))))


def append_if_absent(a: Column, value: Column) -> Column:
    base = F.coalesce(a, F.array().cast("array<string>"))
    return F.when(F.array_contains(base, value), base).otherwise(F.array_append(base, value))


def delete_keys(old: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.join(gone.select(*keys), list(keys), "left_anti")


def cascade_delete(gone: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]]) -> list[DataFrame]:
    """Removes rows of each table that refer to a deleted uri through any of its columns."""
    out = []
    for df, columns in tables:
        for c in columns:
            df = df.join(gone.select(F.col("uri").alias(c)), c, "left_anti")
        out.append(df)
    return out


def write_version(df: DataFrame, label: str) -> str:
    """A new immutable version of a table in the shared folder; readers keep the old path.

    The catalog entry or path pointer is switched by the caller once this
    returns, so a failed write leaves the table as it was.
    """
    path = run_dir(df.sparkSession, label)
    df.write.parquet(path)
    return path
