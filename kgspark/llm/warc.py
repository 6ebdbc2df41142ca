"""WARC archives with an index: records are found by byte range, not by reading archives through.

Writing: of pages with one payload (of ``MIN_REVISIT`` bytes or more) that with
the smallest page_id is the response and the others are revisit records that
refer to it. Each task writes one archive of separately compressed records and
returns one index row per record: file, offset, length, url, digest.

Reading: the selected index rows are sorted by file and offset, neighbouring
ranges are merged (gaps up to ``GAP``, spans up to ``SPAN`` bytes), and each
merged range is one read.

Defined cases: null html is an empty payload; null url an empty target. Rows
that repeat a page_id and its payload are records of one kind each: all are
responses if theirs is the smallest id, else all revisit. Null page_id counts as
larger than any id; if all ids of a payload are null, all are responses. Empty
tables give no archive. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import Optional

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark import session
from kgspark.llm.batches import same, text_chunks, written
from kgspark.llm.storage import Output, Ranges, make_dir

MIN_REVISIT = 100
GAP, SPAN = 64 << 10, 4 << 20
_INDEX = "page_id long, record_type string, refers_to long, file string, offset long, length long, url string, digest string"


def _record(page_id: Optional[int], url: str, payload: bytes, digest: str, revisit: bool, refers_to: Optional[int]) -> bytes:
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Target-URI": "".join(c for c in url if c not in "\r\n"),
        "Content-Type": "text/html; charset=utf-8",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(len(payload)),
    }
    if revisit:
        head["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    block = b"" if revisit else payload
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    raw = b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, out = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz", None
        for part, payloads in text_chunks(batches, "html"):
            out = out or Output(uri)
            cols = {c: part.column(c).to_pylist() for c in ("page_id", "url", "digest", "revisit", "refers_to")}
            rows = []
            for page_id, url, digest, revisit, refers_to, payload in zip(*cols.values(), payloads):
                record = _record(page_id, url or "", payload or b"", digest, revisit, refers_to)
                rows.append((page_id, "revisit" if revisit else "response", refers_to, uri, out.write(record), len(record), url, digest))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=["page_id", "record_type", "refers_to", "file", "offset", "length", "url", "digest"])
        if out:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: Optional[str] = None) -> DataFrame:
    """Writes the archives and returns the index."""
    folder = folder or session.run_dir(pages.sparkSession, "warc")
    make_dir(folder)
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    pages = pages.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "large": F.octet_length("html") >= MIN_REVISIT})
    # Only payloads with a later copy get a row here; identifiers and digests move, pages do not.
    first = (
        pages.where("large").groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1 and first is not null").select("digest", "first")
    )
    copies = pages.where("large").select("page_id", "digest").join(first, "digest").where("page_id is null or page_id > first").distinct()
    copies = copies.select(F.col("page_id").alias("copy_id"), F.col("digest").alias("copy_digest"), F.col("first").alias("refers_to"))
    marked = pages.join(copies, same(F.col("page_id"), F.col("copy_id")) & (F.col("digest") == F.col("copy_digest")), "left")
    marked = marked.select("page_id", "url", "html", "digest", F.col("refers_to").isNotNull().alias("revisit"), "refers_to")
    return written(marked.mapInArrow(_writer(folder), _INDEX), "warc-index")


def merged_ranges(rows: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, int, int]]:
    """(first row, row after the last, offset, length) of the reads for rows of (offset, length) sorted by offset."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(rows):
        if out:
            a, _, start, size = out[-1]
            end = max(start + size, offset + length)
            if offset - (start + size) <= gap and end - start <= span:
                out[-1] = (a, i + 1, start, end - start)
                continue
        out.append((i, i + 1, offset, length))
    return out


_RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = Ranges()
    for batch in batches:
        files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
        at = 0
        while at < len(files):
            stop = at
            while stop < len(files) and files[stop] == files[at]:
                stop += 1
            for a, b, start, size in merged_ranges(list(zip(offsets[at:stop], lengths[at:stop]))):
                data = ranges.read(files[at], start, size)
                rows = []
                for i in range(at + a, at + b):
                    fields, block = parse_record(data[offsets[i] - start : offsets[i] - start + lengths[i]])
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"{files[at]} at {offsets[i]}: the payload does not have its digest")
                    ident = lambda k: (None if fields[k] == "<urn:page:null>" else int(fields[k][10:-1])) if k in fields else None
                    rows.append((ident("WARC-Record-ID"), fields["WARC-Target-URI"], int(fields["WARC-Payload-Length"]), digest, kind, ident("WARC-Refers-To"), block))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
            at = stop
    ranges.close()


def read_records(index: DataFrame) -> DataFrame:
    """The records of the given index rows, read from the archives in merged ranges."""
    spark = index.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = (F.col("offset") / F.lit(SPAN)).cast("long")
    chosen = index.select("file", "offset", "length").repartition(tasks, "file", block).sortWithinPartitions("file", "offset")
    return chosen.mapInArrow(_reader, _RECORDS)
