"""Bulk graph sink: nodes and edges in files by bucket of the node, edges in both orientations.

A load merges into the buckets it touches and publishes all of them at once;
buckets it does not change keep their files, so a repeated load changes nothing
and a node's neighbourhood is one bucket's file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, groupby
from typing import Optional

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from kgspark.session import freed_shuffles
from kgspark.sources.shared_files import locate, read_text, write_text

FORMAT = "graph-buckets"
NODES, OUT, IN = "nodes", "out", "in"
KEYS = {NODES: ["uri"], OUT: ["subject_uri", "predicate", "object_uri"], IN: ["object_uri", "predicate", "subject_uri"]}
#: Rows of a bucket that are held of the stored and of the new ones at a time.
MERGE_ROWS = 1 << 16


@dataclass
class Written(WriterCommitMessage):
    files: dict[str, str]


class _Sorted:
    """Rows of one bucket that come sorted by key, some at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch], schema: pa.Schema, keys: Sequence[str]):
        self.batches, self.schema, self.keys, self.more = batches, schema, keys, True
        self.rows = schema.empty_table()

    def fill(self) -> None:
        held = [self.rows]
        size = self.rows.num_rows
        while self.more and size < MERGE_ROWS:
            batch = next(self.batches, None)
            if batch is None:
                self.more = False
            else:
                held.append(pa.Table.from_batches([batch]).select(self.schema.names).cast(self.schema))
                size += batch.num_rows
        self.rows = pa.concat_tables(held).combine_chunks()

    def last(self) -> list:
        return [self.rows.column(k)[-1].as_py() for k in self.keys]

    def take(self, cut: Optional[list]) -> pa.Table:
        """Rows with keys up to ``cut`` (None: all that are held) leave."""
        if cut is None:
            taken, self.rows = self.rows, self.schema.empty_table()
            return taken
        upto = None
        for key, value in zip(reversed(self.keys), reversed(cut)):
            column = self.rows.column(key)
            # Null comes after all values.
            less = pc.is_valid(column) if value is None else pc.fill_null(pc.less(column, value), False)
            same = pc.is_null(column) if value is None else pc.fill_null(pc.equal(column, value), False)
            upto = pc.or_(less, same if upto is None else pc.and_(same, upto))
        count = pc.sum(upto).as_py() or 0
        taken, self.rows = self.rows.slice(0, count), self.rows.slice(count)
        return taken


def _merged(old: _Sorted, new: _Sorted) -> Iterator[tuple[pa.Table, bool]]:
    """The newest row of each key in the order of keys, in parts, and whether a part differs from the old rows."""
    while True:
        old.fill()
        new.fill()
        if not old.rows.num_rows and not new.rows.num_rows:
            return
        # Up to the smaller of the last keys held, no row of either side is missing.
        ends = [side.last() for side in (old, new) if side.more]
        cut = min(ends, key=lambda end: [(v is None, v) for v in end]) if ends else None
        before = old.take(cut)
        rows = _newest(pa.concat_tables([before, new.take(cut)]), old.keys)
        yield rows, not rows.equals(before)


class BucketWriter(DataSourceArrowWriter):
    """Each task merges whole buckets, one at a time, with what is stored (rows come sorted by bucket and key); a task holds some rows of a bucket, however many it has."""

    def __init__(self, options: dict):
        self.path, self.table, self.buckets = options["path"].rstrip("/"), options["table"], int(options["buckets"])
        self.base = _manifest(self.path)
        self.stored = self.base.get(self.table, {})

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files: dict[str, str] = {}

        def pieces() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in iterator:
                numbers = batch.column("bucket").to_numpy()
                rows = batch.drop_columns(["bucket"])
                at = 0
                while at < len(numbers):
                    stop = int(numbers.searchsorted(numbers[at], side="right"))
                    yield int(numbers[at]), rows.slice(at, stop - at)
                    at = stop

        for bucket, own in groupby(pieces(), key=lambda piece: piece[0]):
            self._merge(bucket, (rows for _, rows in own), files)
        return Written(files)

    def _merge(self, bucket: int, batches: Iterator[pa.RecordBatch], files: dict[str, str]) -> None:
        first = next(batches)
        keys, name = KEYS[self.table], str(bucket)
        new = _Sorted(chain([first], batches), first.schema, keys)
        old = _Sorted(_batches(self.path, self.stored[name]) if name in self.stored else iter(()), first.schema, keys)
        file = f"{self.table}/{bucket:06d}-{uuid.uuid4().hex}.parquet"
        store, at = locate(f"{self.path}/{file}")
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        changed = name not in self.stored
        with pq.ParquetWriter(at, first.schema, filesystem=store, compression="zstd") as out:
            for rows, differs in _merged(old, new):
                out.write_table(rows)
                changed = changed or differs
        if changed:
            files[name] = file
        else:
            store.delete_file(at)

    def commit(self, messages: Sequence[Optional[WriterCommitMessage]]) -> None:
        """Publishes the new files of all tasks with one rename; files of tasks that ran twice belong to nothing."""
        changed = {k: v for m in messages if m is not None for k, v in m.files.items()}
        now = _manifest(self.path)
        if now != self.base:
            raise RuntimeError("another load was published meanwhile")
        if changed:
            write_text(f"{self.path}/manifest.json", json.dumps({**now, "buckets": self.buckets, self.table: {**self.stored, **changed}}, sort_keys=True))

    def abort(self, messages: Sequence[Optional[WriterCommitMessage]]) -> None:
        """Nothing was published, so nothing has to be taken back."""


class GraphBuckets(DataSource):
    """Sink with the options ``path``, ``table`` (nodes, out, in) and ``buckets``; rows hold their bucket number."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BucketWriter(self.options)


def _manifest(path: str) -> dict:
    return json.loads(read_text(f"{path}/manifest.json") or "{}")


def _batches(path: str, file: str) -> Iterator[pa.RecordBatch]:
    store, at = locate(f"{path}/{file}")
    with store.open_input_file(at) as source:
        yield from pq.ParquetFile(source).iter_batches(batch_size=MERGE_ROWS // 4)


def _newest(rows: pa.Table, keys: list[str]) -> pa.Table:
    """The last row of each key, in the order of the keys."""
    numbered = rows.append_column("__at", pa.array(range(rows.num_rows), pa.int64()))
    last = numbered.group_by(keys).aggregate([("__at", "max")]).column("__at_max")
    return rows.take(last).sort_by([(k, "ascending") for k in keys])


def _bucket(column: str, buckets: int):
    return F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int")


def load(rows: DataFrame, path: str, table: str, order: Sequence[str], buckets: int = 64) -> None:
    """Merges rows into one table of the store. Of rows with one key the last in ``order`` stays; later loads win over earlier ones.

    The number of buckets is fixed by the first load. Rows travel once, by bucket.
    """
    spark = rows.sparkSession
    spark.dataSource.register(GraphBuckets)
    buckets = _manifest(path).get("buckets", buckets)
    rest = [c for c in rows.columns if c not in KEYS[table]]
    # Repeats collapse in the map tasks; a row without other columns is its own key.
    last = rows.groupBy(*KEYS[table]).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*KEYS[table], "r.*") if rest else rows.distinct()
    placed = last.withColumn("bucket", _bucket(KEYS[table][0], buckets)).repartition("bucket").sortWithinPartitions("bucket", *[F.col(k).asc_nulls_last() for k in KEYS[table]])
    with freed_shuffles(spark):
        placed.write.format(FORMAT).option("path", path).option("table", table).option("buckets", buckets).mode("append").save()


def load_graph(nodes: DataFrame, edges: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Loads nodes and edges; edges with an endpoint that is neither loaded nor stored come back with a reason."""
    from kgspark.operators.constraints import Reference, Rules, split

    stored = {"nodes": read_table(nodes.sparkSession, path, NODES)} if NODES in _manifest(path) else {}
    numbered = edges.withColumn("edge_at", F.monotonically_increasing_id())
    rules = [Rules("nodes", ("uri",), {"uri": F.col("uri").isNotNull()}),
             Rules("edges", ("edge_at",), {"triple": F.col("subject_uri").isNotNull() & F.col("predicate").isNotNull() & F.col("object_uri").isNotNull(),
                                        "self loop": F.col("subject_uri") != F.col("object_uri")},
                   references=[Reference(("subject_uri",), "nodes", ("uri",)), Reference(("object_uri",), "nodes", ("uri",))])]
    out = split({"nodes": nodes, "edges": numbered}, stored, rules)
    load(out["nodes"][0], path, NODES, [c for c in nodes.columns if c != "uri"], buckets)
    good = out["edges"][0].drop("edge_at")
    rest = [c for c in good.columns if c not in KEYS[OUT]]
    load(good, path, OUT, rest, buckets)
    load(good, path, IN, rest, buckets)
    return out["edges"][1].drop("edge_at")


def read_table(spark: SparkSession, path: str, table: str, node: Optional[str] = None) -> DataFrame:
    """A table of the store, or with ``node`` only the one bucket that can hold it."""
    manifest = _manifest(path)
    files = manifest[table]
    if node is not None:
        number = spark.range(1).select(_bucket_of(node, manifest["buckets"])).first()[0]
        chosen = [files[str(number)]] if str(number) in files else []
    else:
        chosen = list(files.values())
    sample = f"{path}/{next(iter(files.values()))}"
    schema = spark.read.parquet(sample).schema
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in chosen]) if chosen else spark.createDataFrame([], schema)


def _bucket_of(node: str, buckets: int):
    return F.pmod(F.xxhash64(F.lit(node)), F.lit(buckets)).cast("int")


def neighbours(spark: SparkSession, path: str, node: str) -> DataFrame:
    """(other_uri, predicate, direction) of a node: one bucket of each orientation is read."""
    out = read_table(spark, path, OUT, node).filter(F.col("subject_uri") == node).select(F.col("object_uri").alias("other_uri"), "predicate", F.lit("out").alias("direction"))
    back = read_table(spark, path, IN, node).filter(F.col("object_uri") == node).select(F.col("subject_uri").alias("other_uri"), "predicate", F.lit("in").alias("direction"))
    return out.unionByName(back)
