"""Scoring by a hashed maximum-entropy language model with class-factored softmax.

1. Tasks pack documents into blocks: word names of the block, and each text as
   numbers into them. Blocks are written once and never shuffled but to meet
   their counts.
2. Training counts of every token: each block asks for its distinct tokens only,
   so what moves is (block, token) pairs, not words.
3. The model. P(token | history) = P(class | history) * P(token | class). The
   class factor is a softmax over ``CLASSES`` with hashed features of the history:
   the word before, the word before that (a skip), the two words together, the
   pair of their classes, and a bias. The ``TOP`` most frequent tokens have classes of their own, the end
   among them; other words have the class of their last two bytes. P(token |
   class) is additive smoothing over the counts, with one place for unknown words.
4. Training by rounds of distributed gradient updates: each task runs gradient
   steps over its blocks from the shared weights; the changes, weighted by how
   often each feature row was used, are summed in two levels (slice and salt,
   then slice) and become the next weights. Every round uses every training block.
5. Blocks meet their counts and are scored in sparse numpy batches.

The weights have a fixed size (``FEATURES`` + ``PAIRS`` rows of ``CLASSES``), so they
may travel with the tasks. Tokens are told apart by 64-bit names.

Defined cases: null and empty texts are the end alone. A null doc_id counts as
held out. Repeated rows count each. If there is no training text, all counts are 0
and weights stay 0. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.batches import mix, text_chunks, words_in, written
from kgspark.session import freed_shuffles

SMOOTH = 0.1
CLASSES, TOP = 32, 12
FEATURES = 1 << 14
#: Rows of the weights for two words together; they come after the other features'.
PAIRS = (1 << 16) - FEATURES
SLICES, SALTS = 64, 8
BLOCK_WORDS = 2_000_000
BATCH, SLICE_TOKENS = 1 << 14, 1 << 18
ROUNDS, RATE = 2, 0.3
END = np.uint64(0xE4D0F7E87)
BIAS = 0


class Block(NamedTuple):
    doc_ids: np.ndarray
    no_id: np.ndarray
    held_out: np.ndarray
    sizes: np.ndarray   # tokens of each document, with its end
    names: np.ndarray   # distinct tokens
    kinds: np.ndarray   # class by last bytes
    ids: np.ndarray     # tokens of all documents, as numbers into names


def pack(b: Block) -> bytes:
    head = np.array([len(b.doc_ids), len(b.names), len(b.ids)], "<i8").tobytes()
    body = b"".join((b.doc_ids.astype("<i8").tobytes(), b.sizes.astype("<i8").tobytes(), b.names.astype("<u8").tobytes(),
                     b.ids.astype("<i4").tobytes(), b.no_id.astype("u1").tobytes(), b.held_out.astype("u1").tobytes(), b.kinds.astype("u1").tobytes()))
    return zstandard.ZstdCompressor(level=1).compress(head + body)


def unpack(data: bytes) -> Block:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, v, t = np.frombuffer(raw, "<i8", 3).tolist()
    out, at = [], 24
    for kind, size in (("<i8", n), ("<i8", n), ("<u8", v), ("<i4", t), ("u1", n), ("u1", n), ("u1", v)):
        out.append(np.frombuffer(raw, kind, size, at))
        at += out[-1].nbytes
    doc_ids, sizes, names, ids, no_id, held_out, kinds = out
    return Block(doc_ids, no_id.astype(bool), held_out.astype(bool), sizes, names, kinds, ids)


def _packer(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            names = np.concatenate([h[0] for h in held])
            kinds = np.concatenate([h[1] for h in held])
            distinct, first, ids = np.unique(names, return_index=True, return_inverse=True)
            doc_ids = [d for h in held for d in h[3]]
            block = Block(np.array([d or 0 for d in doc_ids], np.int64), np.array([d is None for d in doc_ids]),
                          np.array([d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d in doc_ids]),
                          np.concatenate([h[2] for h in held]), distinct, kinds[first], ids)
            return pa.RecordBatch.from_pydict({"block": pa.array([task << 24 | seq], pa.int64()), "data": pa.array([pack(block)], pa.binary())})

        for part, texts in text_chunks(batches):
            w = words_in([t.lower() if t else t for t in texts])
            raw = np.frombuffer(w.data, np.uint8)
            tail = raw[w.stops - 1].astype(np.uint64) * np.uint64(256) + np.where(w.stops - w.starts > 1, raw[np.maximum(w.stops - 2, 0)], 0).astype(np.uint64)
            kind = (mix(tail, 23) % np.uint64(CLASSES - TOP)).astype(np.uint8) + TOP
            ends = np.cumsum(w.counts)
            held.append((np.insert(w.names, ends, END), np.insert(kind, ends, TOP), w.counts + 1, part.column("doc_id").to_pylist()))
            size += len(w.names) + len(texts)
            if size >= block_words:
                yield flush()
                held, size, seq = [], 0, seq + 1
        if held:
            yield flush()

    return run


def _asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, number, name, kind, c): each block's distinct tokens with their count in its training texts."""
    for batch in batches:
        for key, data in zip(batch.column("block").to_pylist(), batch.column("data")):
            b = unpack(data.as_buffer())
            used = np.repeat(~b.held_out, b.sizes)
            c = np.bincount(b.ids[used], minlength=len(b.names))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(c), key)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(b.names.view(np.int64)),
                 pa.array(b.kinds.astype(np.int8)), pa.array(c)], names=["block", "number", "name", "kind", "c"])


def classes_of(b: Block, top: np.ndarray) -> np.ndarray:
    """Class of each distinct token of a block; ``top`` has the names with classes of their own, in order."""
    order = np.argsort(top)
    spot = np.minimum(np.searchsorted(top, b.names, sorter=order), max(len(top) - 1, 0))
    out = b.kinds.astype(np.int64)
    if len(top):
        found = top[order[spot]] == b.names
        out[found] = order[spot][found]
    return out


def features(b: Block, classes: np.ndarray, pairs: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the weights that each token's history calls, classes of the tokens). Names and pairs of classes are hashed once each, not once per token.

    With ``pairs`` rows for them, the two words before are also one feature together.
    """
    kinds = classes[b.ids]
    place = np.arange(len(b.ids)) - np.repeat(np.cumsum(b.sizes) - b.sizes, b.sizes)

    def back(x: np.ndarray, k: int, none: int) -> np.ndarray:
        out = np.roll(x, k)
        out[place < k] = none
        return out

    def hashed(x: np.ndarray, salt: int) -> np.ndarray:
        return (mix(x, salt) % np.uint64(FEATURES - 1) + np.uint64(1)).astype(np.uint16)

    names = np.append(b.names, np.array([1, 2], np.uint64))  # the last two stand for what is before the text
    rows = np.empty((4 if pairs else 3, len(b.ids)), np.uint16)
    one, two = back(b.ids, 1, len(b.names)), back(b.ids, 2, len(b.names) + 1)
    rows[0] = hashed(names, 31)[one]
    rows[1] = hashed(names, 37)[two]
    rows[2] = hashed(np.arange((CLASSES + 1) ** 2, dtype=np.uint64), 41)[back(kinds, 1, CLASSES) * (CLASSES + 1) + back(kinds, 2, CLASSES)]
    if pairs:
        halves = [(mix(names, salt) % np.uint64(pairs)).astype(np.uint32) for salt in (43, 47)]
        rows[3] = (halves[0][one] + halves[1][two]) % np.uint32(pairs) + np.uint32(FEATURES)
    return rows.T, kinds


def slices(b: Block, tokens: int = SLICE_TOKENS) -> Iterator[Block]:
    """The block in parts of whole documents, about ``tokens`` each, so that what is worked out per token stays small."""
    ends = np.cumsum(b.sizes)
    at = 0
    while at < len(ends):
        begin = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, begin + tokens, side="right")))
        yield b._replace(doc_ids=b.doc_ids[at:stop], no_id=b.no_id[at:stop], held_out=b.held_out[at:stop], sizes=b.sizes[at:stop], ids=b.ids[begin : int(ends[stop - 1])])
        at = stop


#: Sums of weights within this need no shift before their exponentials are summed as float32.
PLAIN = 60


def logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Summed weights of each token's rows by class, less each token's largest where some are far from 0."""
    z = weights.take(rows[:, 0], axis=0)
    for column in range(1, rows.shape[1]):
        z += weights.take(rows[:, column], axis=0)
    z += weights[BIAS]
    if max(z.max(), -z.min()) > PLAIN:
        z -= z.max(axis=1, keepdims=True)
    return z


def softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = logits(weights, rows)
    np.exp(z, out=z)
    z /= np.einsum("ij->i", z)[:, None]
    return z


def log_softmax(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    z = logits(weights, rows)
    z -= np.log(np.einsum("ij->i", np.exp(z)))[:, None]
    return z


def log_of(weights: np.ndarray, rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each token's class."""
    z = logits(weights, rows)
    own = z[np.arange(len(kinds)), kinds]
    return own - np.log(np.einsum("ij->i", np.exp(z, out=z)))


#: Rows of one group that are added side by side with those of the others.
STRIDE = 8


def grouped(g: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``g``'s rows, taken in ``order``, by groups that begin at ``first``.

    Most groups are short, so pieces of at most ``STRIDE`` rows are summed side by side, and only pieces of longer groups one by one.
    """
    times = np.diff(np.append(first, len(order)))
    pieces = -(-times // STRIDE)
    begins = np.cumsum(pieces) - pieces
    starts = (np.arange(pieces.sum()) - np.repeat(begins, pieces)) * STRIDE + np.repeat(first, pieces)
    sizes = np.diff(np.append(starts, len(order)))
    out = g.take(order[starts], axis=0)
    for k in range(1, STRIDE):
        longer = np.flatnonzero(sizes > k)
        out[longer] += g.take(order[starts[longer] + k], axis=0)
    many = pieces > 1
    if not many.any():
        return out
    whole = out.take(begins, axis=0)
    whole[many] = np.add.reduceat(out[np.repeat(many, pieces)], np.cumsum(pieces[many]) - pieces[many], axis=0)
    return whole


def descend(weights: np.ndarray, b: Block, classes: np.ndarray, power: np.ndarray, uses: np.ndarray) -> None:
    """Adaptive gradient steps over a block's training texts, in place; ``power`` holds squared gradients by row."""
    rows, kinds = features(b, classes, len(weights) - FEATURES)
    used = np.repeat(~b.held_out, b.sizes)
    rows, kinds = rows[used], kinds[used]
    for at in range(0, len(kinds), BATCH):
        r, k = rows[at : at + BATCH], kinds[at : at + BATCH]
        g = softmax(weights, r)
        g[np.arange(len(k)), k] -= 1
        for column in range(r.shape[1] + 1):
            if column == r.shape[1]:
                touched, step, times = np.array([BIAS]), g.sum(axis=0, keepdims=True), np.array([len(k)])
            else:
                order = np.argsort(r[:, column], kind="stable")
                ordered = r[order, column]
                first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
                touched, step, times = ordered[first], grouped(g, order, first), np.diff(np.append(first, len(ordered)))
            step /= np.sqrt(times).astype(np.float32)[:, None]
            power[touched] += np.einsum("ij,ij->i", step, step) / CLASSES
            step *= (RATE / np.sqrt(power[touched] + 1e-3)).astype(np.float32)[:, None]
            weights[touched] -= step
            uses[touched] += times


def _round(start: bytes, top: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.frombuffer(start, np.float32).reshape(-1, CLASSES + 1)
        weights, power, uses = before[:, :CLASSES].copy(), before[:, CLASSES].astype(np.float64), np.zeros(len(before))
        for batch in batches:
            for data in batch.column("data"):
                b = unpack(data.as_buffer())
                classes = classes_of(b, top)
                for part in slices(b):
                    descend(weights, part, classes, power, uses)
        if uses.any():
            moved = ((np.column_stack((weights, power)) - before) * uses[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId() % SALTS] * SLICES, pa.int32()),
                 pa.array([x.tobytes() for x in np.split(moved, SLICES)], pa.binary()), pa.array([x.tobytes() for x in np.split(uses, SLICES)], pa.binary())],
                names=["slice", "salt", "moved", "uses"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of each (slice, salt), which come sorted."""
    key, moved, uses = None, None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"slice": pa.array([key[0]], pa.int32()), "salt": pa.array([key[1]], pa.int32()),
                                           "moved": pa.array([moved.astype(np.float32).tobytes()], pa.binary()), "uses": pa.array([uses.tobytes()], pa.binary())})

    for batch in batches:
        for s, t, m, u in zip(*(batch.column(c).to_pylist() for c in ("slice", "salt", "moved", "uses"))):
            if key is not None and key != (s, t):
                yield out()
                key = None
            m, u = np.frombuffer(m, np.float32).astype(np.float64), np.frombuffer(u, np.float64)
            moved, uses = (m, u) if key is None else (moved + m, uses + u)
            key = (s, t)
    if key is not None:
        yield out()


_PARTS = "slice int, salt int, moved binary, uses binary"


def fit(blocks: DataFrame, top: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The weights after ``rounds`` rounds, each over all training blocks.

    A round also hands on the squared gradients (the last column), so that steps get shorter from round to round.
    Its shuffle files are freed when it ends.
    """
    state = np.zeros((FEATURES + PAIRS, CLASSES + 1), np.float32)
    for _ in range(rounds):
        with freed_shuffles(blocks.sparkSession):
            parts = blocks.mapInArrow(_round(state.tobytes(), top), _PARTS)
            for keys in (["slice", "salt"], ["slice"]):
                parts = parts.repartition(SLICES, *keys).sortWithinPartitions(*keys).mapInArrow(_summed, _PARTS).withColumn("salt", F.lit(0) if keys[1:] else F.col("salt"))
            summed = parts.collect()  # SLICES rows, the size of the weights in all
        state = state.copy()
        per = len(state) // SLICES
        for row in summed:
            moved, uses = np.frombuffer(row["moved"], np.float32).reshape(per, CLASSES + 1), np.frombuffer(row["uses"], np.float64)
            at = slice(row["slice"] * per, (row["slice"] + 1) * per)
            state[at] += np.where(uses[:, None] > 0, moved / np.maximum(uses, 1)[:, None], 0).astype(np.float32)
    return state[:, :CLASSES].copy()


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scorer(weights: np.ndarray, top: np.ndarray, n_all: int, n_types: int, class_sums: np.ndarray, class_types: np.ndarray):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        b = unpack(left.column("data").combine_chunks()[0].as_buffer())
        c = np.zeros(len(b.names))
        c[right.column("number").to_numpy()] = right.column("c").to_numpy()
        classes = classes_of(b, top)
        base = np.log10((c + SMOOTH) / (n_all + SMOOTH * (n_types + 1)))
        within = np.log10((c + SMOOTH) / (class_sums + SMOOTH * (class_types + 1))[classes])
        n_known, base_score, scores = [], [], []
        for part in slices(b):
            rows, kinds = features(part, classes, len(weights) - FEATURES)
            own = within[part.ids]
            for at in range(0, len(kinds), BATCH):
                k = kinds[at : at + BATCH]
                own[at : at + BATCH] += log_of(weights, rows[at : at + BATCH], k) / np.log(10)
            begins = np.cumsum(part.sizes) - part.sizes  # every text has its end, so none is empty
            n_known.append(np.add.reduceat((c > 0)[part.ids].astype(np.int64), begins))
            base_score.append(np.add.reduceat(base[part.ids], begins))
            scores.append(np.add.reduceat(own, begins))
        return pa.Table.from_arrays(
            [pa.array(b.doc_ids, pa.int64(), mask=b.no_id), pa.array(b.held_out), pa.array(b.sizes, pa.int64()), pa.array(np.concatenate(n_known)),
             pa.array(np.concatenate(base_score)), pa.array(np.concatenate(scores))], names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def score(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per input row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = written(docs.mapInArrow(_packer(block_words), "block long, data binary"), "blocks")
    asks = blocks.mapInArrow(_asks, "block long, number int, name long, kind byte, c long")
    counts = written(asks.where("c > 0").groupBy("name").agg(F.sum("c").alias("c"), F.first("kind").alias("kind")), "counts")
    end = int(END.astype(np.int64))
    best = counts.where(F.col("name") != end).orderBy(F.desc("c"), "name").limit(TOP - 1).collect()
    top = np.array([end] + [r["name"] for r in best], np.int64).view(np.uint64)
    place = F.coalesce(*[F.when(F.col("name") == int(n), F.lit(k)) for k, n in enumerate(top.view(np.int64))], F.col("kind").cast("int"))
    sums = counts.groupBy(place.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # CLASSES rows at most
    class_sums, class_types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums:
        class_sums[r["k"]], class_types[r["k"]] = r["c"], r["v"]
    n_all, n_types = sum(r["c"] for r in sums), sum(r["v"] for r in sums)
    weights = fit(blocks, top)
    answers = asks.select("block", "number", "name").join(counts.select("name", "c"), "name").select("block", "number", "c")
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scorer(weights, top, n_all, n_types, class_sums, class_types), _SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("bigint").alias("train_tokens"), "base_score", "score")
