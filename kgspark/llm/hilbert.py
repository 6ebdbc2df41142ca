"""Sharding along a Hilbert curve, so that files can be pruned on several metadata columns at once.

Each dimension is quantised by approximate quantiles (a bounded sketch) into
``2**BITS`` cells, the cells are numbered along the curve, and rows are sorted by
that number. Sorted runs are written once; a row's rank is its run's first rank
and its place in the run's file, and the rank alone gives shard and slot. So row
counts are at most one apart (law ``rows``), and texts are shuffled once.

A hot cell is no problem: the sort goes on by text digest and doc_id, and then by
a number per row, so a cell or a row that repeats often is cut like any other run.

Defined cases: null in a dimension is its lowest cell; null text has size 1 and
the digest of nothing. Rows that tie in every sort column lie side by side and may
go to two shards. Empty tables give no shard. Further columns are written along;
one named ``shard`` or ``slot`` gives way, ``curve`` makes ours ``curve_``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from kgspark import session
from kgspark.llm.batches import unused, written

SHARDS, BITS = 16, 5
ACCURACY = 10_000


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Position along the curve of a cell given by ``bits``-bit coordinates (Skilling's transpose form)."""
    # One array column passes through the steps, so that expressions do not nest in themselves.
    n = len(dims)
    state = F.array(*[d.cast("bigint") for d in dims])
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        p = q - 1
        xi, x0 = F.get(x, i), F.get(x, F.lit(0))
        swap = x0.bitwiseXOR(xi).bitwiseAND(p)
        high = xi.bitwiseAND(q) != 0

        def at(v: Column, k: Column) -> Column:
            flipped = F.when(k == 0, v.bitwiseXOR(p)).otherwise(v)
            swapped = F.when((k == 0) | (k == i), v.bitwiseXOR(swap)).otherwise(v)
            return F.when(high, flipped).otherwise(swapped).cast("bigint")

        return F.transform(x, at)

    def decode(x: Column) -> Column:
        """Gray decoding along the dimensions, then the bits of all of them in turn."""
        gray = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.aggregate(F.slice(x, F.lit(1), k), F.lit(0).cast("bigint"), lambda a, v: a.bitwiseXOR(v)))
        return let(gray, lambda g: let(flips(F.element_at(g, n)), lambda f: woven(F.transform(g, lambda v: v.bitwiseXOR(f)))))

    def flips(lowest: Column) -> Column:
        return F.aggregate(F.array(*[F.lit(1 << b).cast("bigint") for b in range(bits - 1, 0, -1)]), F.lit(0).cast("bigint"),
                           lambda t, q: F.when(lowest.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

    def woven(x: Column) -> Column:
        number = F.lit(0).cast("bigint")
        for b in range(bits - 1, -1, -1):
            for i in range(n):
                number = number + F.shiftleft(F.shiftright(F.get(x, F.lit(i)), b).bitwiseAND(F.lit(1).cast("bigint")), b * n + n - 1 - i)
        return number

    return let(F.aggregate(steps, state, turn), decode)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_number(column: Column, kind: str) -> Column:
    """A number that keeps the order of the values: strings by their first seven bytes."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(column.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")
    return column.cast("double")


def quantised(df: DataFrame, dims: list[str], bits: int = BITS) -> list[Column]:
    """Cells of each dimension; the cuts are at most ``2**bits - 1`` numbers per dimension."""
    kinds = dict(df.dtypes)
    numbers = {d: as_number(F.col(d), kinds[d]) for d in dims}
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = df.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(d) for d, c in numbers.items()]).first()

    def cell(bounds: list) -> Callable[[Column], Column]:
        return lambda number: F.aggregate(F.array(*[F.lit(float(x)) for x in bounds]), F.lit(0), lambda n, x: n + F.when(number > x, 1).otherwise(0))

    return [let(c, cell(cuts[d] or [0.0])) for d, c in numbers.items()]


def shard(df: DataFrame, dims: list[str], ties: list[str], shards: int = SHARDS, folder: str | None = None, bits: int = BITS) -> DataFrame:
    """Writes ``df`` as Parquet, one folder per shard, each file a run along the curve; returns it with shard and slot, read from there."""
    spark = df.sparkSession
    curve, copy, run, at, base, n = unused(df.columns + ["shard", "slot"], "curve", "copy", "run", "at", "base", "n")
    # ``copy`` parts repeated rows. It is not asked for again: what is written keeps its place.
    placed = df.withColumn(curve, hilbert_index(quantised(df, dims, bits), bits)).withColumn(copy, F.monotonically_increasing_id())
    order = [curve, *ties, copy]
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order).drop(copy)
    runs = written(ordered.withColumn(run, F.spark_partition_id()), "curve-runs").withColumn(at, F.col("_metadata.row_index"))
    sizes = runs.groupBy(run).agg(F.count(F.lit(1)).alias(n), (F.max(at) + 1).alias(at))
    sizes = written(sizes.select(run, n, at, (F.sum(n).over(Window.orderBy(run)) - F.col(n)).alias(base)), "curve-sizes")
    total, whole = sizes.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.bool_and(F.col(n) == F.col(at)), F.lit(True))).first()
    if not whole:
        raise ValueError("runs were not written one file each")
    # Shard s holds the ranks from ceil(total * s / shards) on.
    ranked = runs.join(sizes.select(run, base), run).withColumn(base, F.col(base) + F.col(at)).drop(run, at)
    ranked = ranked.withColumn("shard", F.expr(f"cast(`{base}` * {shards}L div {max(total, 1)}L as int)"))
    ranked = ranked.withColumn("slot", F.col(base) - F.expr(f"({total}L * shard + {shards - 1}L) div {shards}L")).drop(base)
    folder = folder or session.run_dir(spark, "shards")
    ranked.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return spark.read.schema(ranked.drop("shard").schema.add("shard", IntegerType())).parquet(folder)
