"""Fill-in-middle transformation by block rotation in place.

A text is cut at line ends into prefix, middle and suffix. The sentinels go into
a bytearray as ``<P>`` prefix ``<M>`` middle ``<S>`` suffix; one rotation then
exchanges two neighbouring segments by three reversals, and the opposite
rotation restores the text exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kgspark.llm.batches import text_chunks

PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
#: Bytes moved at once in a reversal, so that it needs no second copy of the text.
STEP = 1 << 16
_OWN = T.StructType().add("fim_lines", "long").add("fim_form", "string").add("fim_prefix_chars", "long").add("fim_middle_chars", "long").add("fim_text", "string")
_RESTORED = T.StructType().add("fim_restored", "string")


def reverse(data: np.ndarray, a: int, b: int) -> None:
    """Reverses data[a:b] in place, from both ends inwards."""
    while b - a > 1:
        k = min(STEP, (b - a) // 2)
        left = data[a : a + k].copy()
        data[a : a + k] = data[b - k : b][::-1]
        data[b - k : b] = left[::-1]
        a, b = a + k, b - k


def rotate(buffer: bytearray, a: int, middle: int, b: int) -> None:
    """Exchanges buffer[a:middle] and buffer[middle:b] in place."""
    data = np.frombuffer(buffer, np.uint8)
    reverse(data, a, middle)
    reverse(data, middle, b)
    reverse(data, a, b)


def line_ends(text: bytes) -> np.ndarray:
    """Byte offsets at which the lines end; a last line may lack its line feed."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.append(ends, len(text)) if text and text[-1] != 10 else ends


def draws(seed: int, doc_id) -> list[int]:
    """Four numbers that only seed and id decide, so that a repeated task cuts alike; a null id is an empty one."""
    code = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(code[i : i + 8], 16) for i in (0, 8, 16, 24)]


def scan_cuts(text: bytes, numbers: list[int]) -> tuple[int, int, int]:
    """Number of lines, and the byte offsets at which prefix and middle end."""
    edges = np.append(0, line_ends(text))
    first, second = sorted(int(edges[h % len(edges)]) for h in numbers[:2])
    return len(edges) - 1, first, second


def arrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    buffer = bytearray(text)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = mark
    middle = first + len(PREFIX)
    suffix = second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def disarrange(output: bytes, form: str) -> bytearray:
    """The text, from the output and its form alone."""
    buffer = bytearray(output)
    if form == "plain":
        return buffer
    start, behind = (buffer.index(SUFFIX), MIDDLE) if form == "psm" else (0, PREFIX)
    cut = buffer.index(behind)
    rotate(buffer, start, cut, len(buffer))
    suffix = len(buffer) - (cut - start)
    for at, mark in ((suffix, SUFFIX), (buffer.index(MIDDLE), MIDDLE), (0, PREFIX)):
        del buffer[at : at + len(mark)]
    return buffer


def _chars(text: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def _row(text: bytes, doc_id, seed: int, rate: int, spm_rate: int) -> tuple:
    numbers = draws(seed, doc_id)
    n, first, second = scan_cuts(text, numbers)
    if not text or any(mark in text for mark in (PREFIX, MIDDLE, SUFFIX)) or numbers[2] % 100 >= rate:
        return n, "plain", None, None, text
    form = "spm" if numbers[3] % 100 < spm_rate else "psm"
    return n, form, _chars(text[:first]), _chars(text[first:second]), bytes(arrange(text, first, second, form))


def _append(part: pa.RecordBatch, keep: list[str], columns: list, schema: T.StructType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    own = [pa.array(c, pa.binary()).cast(pa.string()) if f.name in ("fim_text", "fim_restored") else pa.array(c, kinds[f.dataType.simpleString()])
           for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays([part.column(k) for k in keep] + own, names=keep + schema.names)


def _kept(df: DataFrame, schema: T.StructType) -> tuple[list[str], T.StructType]:
    """Columns that stay beside the operator's own, and the result's schema."""
    own = {n.lower() for n in schema.names}
    fields = [f for f in df.schema if f.name.lower() not in own]
    return [f.name for f in fields], T.StructType(fields + schema.fields)


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with the arranged text and how it came about, one row per input row.

    ``rate`` percent of the texts are arranged, ``spm_rate`` percent of those
    with the suffix first; cuts lie at line ends and follow from seed and id. A
    null text is empty; an empty text, and one with a sentinel, stays ``plain``.
    Repeated rows are arranged alike. Columns of the input that bear a name of
    the result (``fim_...``, in any case) give way to it, all others stay.
    """
    keep, schema = _kept(docs, _OWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, text_column):
            rows = [_row(t or b"", i, seed, rate, spm_rate) for t, i in zip(texts, part.column(id_column).to_pylist())]
            yield _append(part, keep, list(zip(*rows)), _OWN)

    return docs.mapInArrow(run, schema)


def restore(arranged: DataFrame) -> DataFrame:
    """``arranged`` with the text before the transformation (``fim_restored``), from ``fim_text`` and ``fim_form``."""
    keep, schema = _kept(arranged, _RESTORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "fim_text"):
            rows = [bytes(disarrange(t, f)) for t, f in zip(texts, part.column("fim_form").to_pylist())]
            yield _append(part, keep, [rows], _RESTORED)

    return arranged.mapInArrow(run, schema)
