"""Token ids in binary files made of independent zstandard frames with a trailing seek table.

File layout: data frames, each holding whole documents' ids (little-endian
unsigned 16 or 32 bit); one skippable frame with the document index (per
document: id, whether the id is null, number of ids); one skippable frame that
is the seek table of zstandard's public seekable format (per frame: compressed
size, size, checksum). A reader takes the tail, picks the frames that hold the
documents it wants, and decompresses only those.

Documents are range-partitioned by id, so file order is id order. A cumulative
sum over one row per file turns positions in a file into global ones.

Defined cases: null and empty text give the end id alone. Null doc_id sorts
first. Rows that repeat a doc_id stand next to each other, ordered by text. A
document longer than a frame has a frame of its own. Empty tables give no file.
Further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple, Optional

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgspark import session
from kgspark.llm.batches import text_chunks, words_in, written
from kgspark.llm.storage import Output, Ranges, make_dir

INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
FRAME_BYTES = 1 << 18
LEVEL = 1
#: Cached chunks of text in a Python worker, and unseen ones encoded in one call.
CACHE, AT_ONCE = 1_500_000, 20_000
#: An added token that cannot come out of ordinary text; it parts the chunks of one call.
PART = "<|startoftext|>"
#: What the vocabulary's pattern sets apart, for lower-case ASCII.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of texts by a tokenizer that never joins what white space parts.

    White space ends every piece of such a vocabulary, so a text's ids are those
    of its chunks in turn. Each distinct chunk is encoded once per worker, many
    in one call. Chunks of letters are one piece before merging, whose last id
    carries the word end; others are parted by an added token.
    """

    def __init__(self, path: str, part: str = PART):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.part, self.part_id = part, self.tokenizer.token_to_id(part)
        size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.names, self.at, self.size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, self.kind)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def _pieces(self, chunk: str) -> list[str]:
        """The parts of a chunk that the vocabulary's own pattern sets apart; none if that is not plain to see."""
        if chunk.lower().isalpha():
            return [chunk]
        if chunk.isascii() and chunk.isprintable() and "<|" not in chunk:
            return PIECES.findall(chunk.lower())
        if chunk[-1] in ".," and chunk[:-1].lower().isalpha():  # lower case may add a mark
            return [chunk[:-1], chunk[-1]]
        return []

    def _encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(pieces), AT_ONCE):
            some = pieces[i : i + AT_ONCE]
            ids = self._ids(" ".join(some))
            stops = np.flatnonzero(self.ends[ids]) + 1
            # A letter whose lower case has a mark of its own parts its word; then each piece is encoded apart.
            whole = len(stops) == len(some)
            out += [ids[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())] if whole else self._encode_parted(some)
        return out

    def _encode_parted(self, chunks: list[str]) -> list[np.ndarray]:
        """Chunks of any kind; those that may hold an added token are encoded by themselves."""
        plain = [c for c in chunks if "<|" not in c]
        out = {c: self._ids(c) for c in chunks if "<|" in c}
        for i in range(0, len(plain), AT_ONCE):
            ids = self._ids(self.part.join(plain[i : i + AT_ONCE]))
            cuts = np.flatnonzero(ids == self.part_id)
            for c, a, b in zip(plain[i : i + AT_ONCE], np.append(0, cuts + 1).tolist(), np.append(cuts, len(ids)).tolist()):
                out[c] = ids[a:b]
        return [out[c] for c in chunks]

    def _add(self, names: np.ndarray, ids: list[np.ndarray]) -> None:
        """Puts new names (sorted) and their ids into the table."""
        if not ids:
            return
        size = np.array([len(x) for x in ids], np.int64)
        at = len(self.pool) + np.cumsum(size) - size
        spot = np.searchsorted(self.names, names)
        self.pool = np.concatenate([self.pool, *ids])
        self.at, self.size = np.insert(self.at, spot, at), np.insert(self.size, spot, size)
        self.names = np.insert(self.names, spot, names)

    def _unknown(self, names: np.ndarray) -> np.ndarray:
        spot = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return self.names[spot] != names if len(self.names) else np.ones(len(names), bool)

    def _learn(self, chunks: list[str], names: np.ndarray) -> None:
        """Adds unknown chunks, whose sorted names are given."""
        one = np.array([c.lower().isalpha() for c in chunks])
        self._add(names[one], self._encode_pieces([c for c, x in zip(chunks, one) if x]))
        chunks, names = [c for c, x in zip(chunks, one) if not x], names[~one]
        parts = [self._pieces(c) for c in chunks]
        pieces = sorted({p for ps in parts for p in ps})
        own = words_in([" ".join(pieces).encode()]).names
        order = np.argsort(own)
        order = order[self._unknown(own[order])]
        self._add(own[order], self._encode_pieces([pieces[i] for i in order.tolist()]))
        left = self._unknown(names)
        chunks, parts, names = [c for c, x in zip(chunks, left) if x], [p for p, x in zip(parts, left) if x], names[left]
        spot = np.searchsorted(self.names, own)
        where = {p: (a, a + n) for p, a, n in zip(pieces, self.at[spot].tolist(), self.size[spot].tolist())}
        odd = [c for c, ps in zip(chunks, parts) if not ps]
        known = dict(zip(odd, self._encode_parted(odd)))
        pool = self.pool
        self._add(names, [np.concatenate([pool[slice(*where[p])] for p in ps]) if ps else known[c] for c, ps in zip(chunks, parts)])

    def encode(self, texts: list) -> list[np.ndarray]:
        # The vocabulary lower-cases, so A-Z may go first; not beside "<|", where lower case could make an added token.
        found = words_in([(t if b"<|" in t else t.lower()) if t else t for t in texts], marks=True)
        if len(self.names) > CACHE:
            self.forget()
        names, first, inverse = np.unique(found.names, return_index=True, return_inverse=True)
        new = self._unknown(names)
        if new.any():
            self._learn([found.word(i).decode() for i in first[new].tolist()], names[new])
        spot = np.searchsorted(self.names, names)
        at, size = (self.at[spot][inverse], self.size[spot][inverse]) if len(names) else (self.at[:0], self.size[:0])
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.arange(total) + np.repeat(at - (ends - size), size)]
        cuts = np.append(0, ends)[np.cumsum(found.counts)]
        return np.split(ids, cuts[:-1]) if len(cuts) else []


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class _File:
    """Gathers documents into frames and writes the tail."""

    def __init__(self, uri: str):
        self.out = Output(uri)
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[Optional[int], int, int]] = []
        self.buffer: list[bytes] = []
        self.held = 0

    def add(self, doc_id: Optional[int], ids: bytes, n: int) -> None:
        if self.held and self.held + len(ids) > FRAME_BYTES:
            self.flush()
        self.docs.append((doc_id, len(self.frames), n))
        self.buffer.append(ids)
        self.held += len(ids)

    def flush(self) -> None:
        data = b"".join(self.buffer)
        frame = self.pack.compress(data)
        self.out.write(frame)
        self.frames.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.buffer, self.held = [], 0

    def close(self, width: int) -> int:
        if self.buffer:
            self.flush()
        ids = np.array([d if d is not None else 0 for d, _, _ in self.docs], "<i8")
        body = struct.pack("<BQ", width, len(ids)) + self.pack.compress(
            ids.tobytes() + np.array([d is None for d, _, _ in self.docs], "u1").tobytes()
            + np.array([f for _, f, _ in self.docs], "<i8").tobytes() + np.array([n for _, _, n in self.docs], "<i8").tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUMS, FOOTER_MAGIC)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
        self.out.close()
        return len(self.frames)


_MANIFEST = "seq int, file string, n_docs long, n_tokens long, n_frames long"


def _writer(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, coder, tokens = None, encoder(path), 0
        seq = TaskContext.get().partitionId()
        uri = f"{folder}/part-{seq:06d}.ids.zst"
        end = np.array([end_id], coder.kind).tobytes()
        for part, texts in text_chunks(batches):
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), coder.encode(texts)):
                file = file or _File(uri)
                n = len(ids) + 1
                file.add(doc_id, ids.tobytes() + end, n)
                tokens += n
        if file:
            n_docs = len(file.docs)
            frames = file.close(coder.kind.itemsize)
            yield pa.RecordBatch.from_pydict({"seq": pa.array([seq], pa.int32()), "file": [uri], "n_docs": [n_docs], "n_tokens": [tokens], "n_frames": [frames]})

    return run


def write_tokens(docs: DataFrame, folder: Optional[str] = None, path: Optional[str] = None, end_id: int = 2) -> DataFrame:
    """Writes the files and returns the manifest: seq, file, n_docs, n_tokens, n_frames; files in ascending doc_id order."""
    folder = folder or session.run_dir(docs.sparkSession, "tokens")
    make_dir(folder)
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(_writer(folder, path or tokenizer_path(), end_id), _MANIFEST), "manifest")


class Tail(NamedTuple):
    width: int
    doc_ids: np.ndarray
    is_null: np.ndarray
    frame: np.ndarray
    n_tokens: np.ndarray
    offset: np.ndarray  # of frames
    size: np.ndarray    # compressed, raw, checksum per frame


def read_tail(ranges: Ranges, uri: str) -> Tail:
    whole = ranges.size(uri)
    count, _, magic = struct.unpack("<IBI", ranges.read(uri, whole - 9, 9))
    if magic != FOOTER_MAGIC:
        raise ValueError(f"{uri}: no seek table")
    size = np.frombuffer(ranges.read(uri, whole - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
    at = int(size[:, 0].sum())
    magic, length = struct.unpack("<II", ranges.read(uri, at, 8))
    if magic != INDEX_MAGIC:
        raise ValueError(f"{uri}: no document index")
    body = ranges.read(uri, at + 8, length)
    width, n = struct.unpack("<BQ", body[:9])
    raw = zstandard.ZstdDecompressor().decompress(body[9:])
    eight = lambda k, skip: np.frombuffer(raw, "<i8", n, 8 * n * k + skip)
    return Tail(width, eight(0, 0), np.frombuffer(raw, "u1", n, 8 * n).astype(bool), eight(1, n), eight(2, n),
                np.append(0, np.cumsum(size[:, 0]))[:-1], size)


def read_frame(ranges: Ranges, uri: str, tail: Tail, k: int) -> np.ndarray:
    packed, raw_size, checksum = tail.size[k].tolist()
    data = zstandard.ZstdDecompressor().decompress(ranges.read(uri, int(tail.offset[k]), packed), max_output_size=max(raw_size, 1))
    if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != checksum:
        raise ValueError(f"{uri}: frame {k} is damaged")
    return np.frombuffer(data, f"<u{tail.width}")


def documents_in(uri: str, wanted: Optional[set] = None) -> Iterator[tuple[Optional[int], int, int, np.ndarray]]:
    """(doc_id, position in the file, tokens before it in the file, ids), opening only the frames that hold ``wanted``."""
    ranges = Ranges()
    tail = read_tail(ranges, uri)
    before = np.cumsum(tail.n_tokens) - tail.n_tokens
    at, frame, first = -1, None, 0
    for i, (doc_id, null, k, n) in enumerate(zip(tail.doc_ids.tolist(), tail.is_null.tolist(), tail.frame.tolist(), tail.n_tokens.tolist())):
        doc_id = None if null else doc_id
        if wanted is not None and doc_id not in wanted:
            continue
        if k != at:
            at, frame = k, read_frame(ranges, uri, tail, k)
            first = int(before[np.searchsorted(tail.frame, k)])
        a = int(before[i]) - first
        yield doc_id, i, int(before[i]), frame[a : a + n]
    ranges.close()


_ROWS = "seq int, doc_id long, position long, before long, n_tokens long, ids_crc32 long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seq, uri in zip(batch.column("seq").to_pylist(), batch.column("file").to_pylist()):
            rows = [(d, i, b, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, i, b, ids in documents_in(uri)]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array([seq] * len(rows), pa.int32()), *(pa.array(c, pa.int64()) for c in columns)],
                names=["seq", "doc_id", "position", "before", "n_tokens", "ids_crc32"])


def read_back(manifest: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens and ids_crc32, from the files alone."""
    offsets = manifest.select("seq", "file", (F.sum("n_tokens").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))).alias("base"))
    files = max(1, min(manifest.count(), 100_000))
    rows = manifest.select("seq", "file").repartition(files, "seq").mapInArrow(_digests, _ROWS)
    return rows.join(offsets.select("seq", F.coalesce("base", F.lit(0).cast("bigint")).alias("base")), "seq").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
