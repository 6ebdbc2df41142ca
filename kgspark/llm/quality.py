"""Quality rules judged by host.

Each document is measured by itself. Failures of every rule are counted per
host, the rates are shrunk towards the corpus with a beta prior fitted to the
hosts (method of moments), and the host verdicts go back to the documents:

* a host whose shrunk rate of *base* failures reaches ``reject_rate`` is
  rejected as a whole;
* a host whose shrunk rate of a further rule reaches ``strict_rate`` is strict in
  that rule: its documents that fail the rule are rejected, while such a
  document of a better host stays.

Counting by host combines on the map side, and the join back has one row per
host on its small side, so a hot host is split like any skewed join.

Defined cases: null text has no words (and so fails the base rule). A null host
is a host of its own. Repeated rows count each. An empty table gives no rows.
Further columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kgspark.llm.batches import same, text_chunks, words_in, written

REPEAT = 8
REJECT_RATE, STRICT_RATE = 0.5, 0.25
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_NO_CHAR = _SPACE + bytes(range(0x80, 0xC0))


def repeated_words(names: np.ndarray, text: bytes, width: int = REPEAT) -> int:
    """Words in windows of ``width`` words that occur twice or more in a text; ``names`` has its words' names."""
    n = len(names) - width + 1
    if n < 2:
        return 0
    code = np.zeros(n, np.uint64)
    for k in range(width):
        code = code * np.uint64(0x5851F42D4C957F2D) + names[k : k + n]
    order = np.sort(code)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    words = text.split()
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(np.isin(code, twice)).tolist():
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    step = np.zeros(len(words) + 1, np.int64)
    for at in seen.values():
        if len(at) > 1:
            step[at] += 1
            step[np.array(at) + width] -= 1
    return int((np.cumsum(step[:-1]) > 0).sum())


_MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in text_chunks(batches):
        found = words_in(texts)
        ends = np.cumsum(found.counts)
        rows = np.zeros((len(texts), len(_MEASURES)), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            own = found.names[ends[i] - found.counts[i] : ends[i]]
            lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
            rows[i] = (len(own), len(text.translate(None, _NO_CHAR)), len(text) - len(text.translate(None, _SYMBOLS)),
                       len(lines), len(lines) - len(set(lines)), repeated_words(own, text))
        carried = [c for c in part.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(c) for c in carried), *(pa.array(rows[:, k]) for k in range(len(_MEASURES)))], names=[*carried, *_MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with the measures of each whole text."""
    schema = StructType([f for f in docs.schema if f.name != "text"] + [StructField(m, LongType()) for m in _MEASURES])
    return docs.mapInArrow(_measure, schema)


#: Rules by name; integer arithmetic only, so that every engine agrees.
RULES = {
    "base": "n_words < 20 or 100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_lines",
    "length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}


def fit_prior(counts: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and strength of each rule's beta prior, from one row of sums over hosts."""
    n = F.col("n")
    sums = counts.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"),
        *[F.sum(f"f_{r}").alias(f"f_{r}") for r in RULES], *[F.sum(F.col(f"f_{r}") * F.col(f"f_{r}") / n).alias(f"s_{r}") for r in RULES]).first()
    prior = {}
    for r in RULES:
        if not sums["n"]:
            prior[r] = (0.0, 1.0)
            continue
        m = sums[f"f_{r}"] / sums["n"]
        noise = m * (1 - m)
        between = max(sums[f"s_{r}"] / sums["n"] - m * m - noise * sums["hosts"] / sums["n"], noise / 1e6)
        prior[r] = (m, max(noise / between - 1, 1.0) if between > 0 else 1.0)
    return prior


def host_verdicts(measured: DataFrame) -> DataFrame:
    """Per host: documents, failures and shrunk rate of each rule."""
    counts = measured.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"fails_{r}")).alias(f"f_{r}") for r in RULES])
    prior = fit_prior(counts)
    return counts.select("source", "n", *[f"f_{r}" for r in RULES], *[
        ((F.col(f"f_{r}") + F.lit(m * k)) / (F.col("n") + F.lit(k))).alias(f"rate_{r}") for r, (m, k) in prior.items()])


def _judged(measured: DataFrame, reject_rate: float, strict_rate: float) -> DataFrame:
    measured = measured.withColumns({f"fails_{r}": F.expr(e) for r, e in RULES.items()})
    hosts = host_verdicts(measured).select(
        F.col("source").alias("host"), (F.col("rate_base") >= reject_rate).alias("host_rejected"),
        *[(F.col(f"rate_{r}") >= strict_rate).alias(f"strict_{r}") for r in RULES if r != "base"])
    # A written table has a known size, so Spark broadcasts the verdicts only if they are small.
    joined = measured.join(written(hosts, "hosts"), same(F.col("source"), F.col("host")), "left")
    strict = F.lit(False)
    for r in RULES:
        if r != "base":
            strict = strict | (F.col(f"strict_{r}") & F.col(f"fails_{r}"))
    return joined.withColumns({"base_failed": F.col("fails_base"), "kept": ~F.col("fails_base") & ~F.col("host_rejected") & ~strict})


def judge(docs: DataFrame, reject_rate: float = REJECT_RATE, strict_rate: float = STRICT_RATE) -> DataFrame:
    """Measures, base_failed, host_rejected and kept for each document."""
    measured = written(measure(docs.select("doc_id", "source", "text")), "quality")
    return _judged(measured, reject_rate, strict_rate).select("doc_id", "source", *_MEASURES, "base_failed", "host_rejected", "kept")


def filter_kept(docs: DataFrame, reject_rate: float = REJECT_RATE, strict_rate: float = STRICT_RATE) -> DataFrame:
    """The documents that are kept, with their own columns."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", "text")
    return _judged(written(measure(rows), "quality"), reject_rate, strict_rate).where("kept").select("row.*")
