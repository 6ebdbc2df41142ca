"""Peers' event files as a stream with an offset per peer.

Every peer has a folder ``peer=<name>`` with immutable Parquet files whose
paths ascend in the order they were written. The offset of a peer is the last
path read, so peers advance independently and a new one starts at its beginning.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kgspark.sources.shared_files import files_below, folders_in, locate, read_text, write_text

FORMAT = "peer-events"
_FOLDER = "peer="


@dataclass
class PeerFile(InputPartition):
    peer: str
    uri: str


class PeerReader(DataSourceStreamReader):
    """Plans micro-batches: of each peer at most ``filespertrigger`` files, and no peer again before its interval has passed.

    Spark asks for the newest offset without saying where the stream stands.
    What was planned is therefore written to ``progress`` before it is returned:
    after a restart the plan is never behind the checkpoint, so nothing is read
    twice, and what was planned but not yet read comes with the next batch.
    """

    def __init__(self, options: dict, schema: StructType):
        self.path = options["path"].rstrip("/")
        self.progress = options["progress"]
        self.limit = int(options.get("filespertrigger", 0))
        self.seconds = float(options.get("pollseconds", 0))
        self.schema = schema
        self.asked: dict[str, float] = {}
        self.planned = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.planned is None:
            self.planned = json.loads(read_text(self.progress) or "{}")
        now, ahead = time.monotonic(), dict(self.planned)
        for folder in folders_in(self.path):
            peer = folder[len(_FOLDER):]
            if not folder.startswith(_FOLDER) or now - self.asked.get(peer, float("-inf")) < self.seconds:
                continue
            self.asked[peer] = now
            new = self._files(folder, self.planned.get(peer, ""))
            if new:
                ahead[peer] = (new[: self.limit] if self.limit else new)[-1]
        if ahead != self.planned:
            write_text(self.progress, json.dumps(ahead))
            self.planned = ahead
        return ahead

    def _files(self, folder: str, after: str, upto: str = "") -> list[str]:
        return [f for f in files_below(f"{self.path}/{folder}", ".parquet") if f > after and (not upto or f <= upto)]

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [PeerFile(unquote(peer), f"{self.path}/{_FOLDER}{peer}/{f}") for peer, upto in sorted(end.items()) if upto != start.get(peer)
                for f in self._files(_FOLDER + peer, start.get(peer, ""), upto)]

    def read(self, partition: PeerFile) -> Iterator[pa.RecordBatch]:
        store, path = locate(partition.uri)
        target = to_arrow_schema(self.schema)
        with store.open_input_file(path) as source:
            file = pq.ParquetFile(source)
            wanted = [n for n in target.names if n in file.schema_arrow.names]
            for batch in file.iter_batches(columns=wanted):
                yield pa.RecordBatch.from_arrays([self._column(batch, f, partition.peer) for f in target], schema=target)

    @staticmethod
    def _column(batch: pa.RecordBatch, field: pa.Field, peer: str) -> pa.Array:
        if field.name in batch.schema.names:
            return batch.column(field.name).cast(field.type)
        return pa.array([peer if field.name == "peer" else None] * batch.num_rows, field.type)


class PeerEvents(DataSource):
    """Options: ``path`` and ``progress`` (needed), ``filespertrigger`` and ``pollseconds`` (0: no bound). A column ``peer`` is the peer's name."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("give the events' schema with .schema(...)")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PeerReader(self.options, schema)


def read_peers(spark: SparkSession, path: str, schema, progress: str, files_per_trigger: int = 0, poll_seconds: float = 0) -> DataFrame:
    """Events of all peers below ``path`` as a stream; ``progress`` is a file of this stream alone, beside its checkpoint."""
    spark.dataSource.register(PeerEvents)
    reader = spark.readStream.format(FORMAT).schema(schema).option("progress", progress)
    return reader.option("filespertrigger", files_per_trigger).option("pollseconds", poll_seconds).load(path)


def write_peer_files(events: DataFrame, path: str, order: str, slices: int = 4) -> None:
    """Lays events (with a column ``peer``) out for ``read_peers``: files of ascending time ranges of ``order`` for each peer.

    Ranges are of equal width over the whole table, so that a reader who takes a
    file of each peer at a time sees all peers advance together.
    """
    if not re.fullmatch(r"\w+", order):
        raise ValueError("order is the name of one column")
    low, high = events.agg(F.unix_micros(F.min(order)), F.unix_micros(F.max(order))).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // slices))
    part = F.format_string("%06d", F.floor((F.unix_micros(order) - F.lit(low or 0)) / width))
    rows = events.withColumn("slice", F.coalesce(part, F.lit("000000")))
    rows.repartition("peer", "slice").sortWithinPartitions("peer", "slice", order).write.partitionBy("peer", "slice").parquet(path)
