"""Near-duplicates by SimHash fingerprints, found in BK-trees.

Fingerprints within the radius agree in at least one of radius + 1 bands of
their bits. Each band value is a shard with a tree of its own, whose children
are keyed by their Hamming distance to the parent; a search follows only the
edges within the radius. A shard that would be too large is split by further
bands of the bits not yet fixed, so every tree is bounded and no link is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.batches import text_chunks, written
from kgspark.llm.graph import components

BITS, SEED, WIDTH, RADIUS = 64, 42, 3, 2
#: Most fingerprints of a tree, rows of trees that a task holds at once (about), and queries that search together.
TREE, GROUP_ROWS, QUERIES = 4096, 4096, 256
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Bit by bit the majority of the shingles' hashes; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    starts = np.append(0, ends)[: len(stops)].tolist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops)), ">u8", len(stops))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at : at + COUNTED]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long), one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches):
            codes = np.array([fingerprint(t or b"", width) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(codes.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class Trees(NamedTuple):
    """BK-trees over ``codes``: the root of each code's tree, and each node's child at every distance (-1: none)."""

    codes: np.ndarray
    root: np.ndarray
    child: np.ndarray


def grow(codes: np.ndarray, root: np.ndarray) -> Trees:
    """The trees that inserting the codes of each tree in order gives; ``root`` names the first of each tree.

    All codes descend together, a step at a time: of those that meet at one
    node with one distance the first becomes the child, the others go on from it.
    """
    child = np.full((len(codes), BITS + 1), -1, np.int32)
    item = np.flatnonzero(root != np.arange(len(codes)))
    node = root[item]
    while len(item):
        distance = np.bitwise_count(codes[item] ^ codes[node]).astype(np.int64)
        _, first, place = np.unique(node * (BITS + 1) + distance, return_index=True, return_inverse=True)
        child[node[first], distance[first]] = item[first]
        node = item[first][place]
        stays = node != item
        item, node = item[stays], node[stays]
    return Trees(codes, root, child)


def search(trees: Trees, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) of the codes number ``asked`` and all codes of their trees within the radius."""
    query, node = asked, trees.root[asked]
    found = []
    while len(query):
        distance = np.bitwise_count(trees.codes[query] ^ trees.codes[node]).astype(np.int64)
        near = distance <= radius
        found.append((query[near], node[near]))
        steps = []
        for edge in range(-radius, radius + 1):
            at = distance + edge
            inside = (at >= 0) & (at <= BITS)
            below = trees.child[node[inside], at[inside]]
            steps.append((query[inside][below >= 0], below[below >= 0].astype(np.int64)))
        query, node = (np.concatenate(x) for x in zip(*steps))
    return tuple(np.concatenate(x) for x in zip(*found))


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (a, b) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], low)
        np.minimum.at(now, label[b], low)
        while not np.array_equal(now, now[now]):
            now = now[now]
        if np.array_equal(now, label):
            return label
        label = now


def _links(radius: int):
    def run(table: pa.Table) -> pa.Table:
        """Links (a, b) of one group of trees, as stars around the smallest of each local component."""
        table = table.sort_by([("mask", "ascending"), ("value", "ascending"), ("fp", "ascending")])
        mask, value, codes = (table.column(c).to_numpy() for c in ("mask", "value", "fp"))
        first = np.append(True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
        root = np.flatnonzero(first)[np.cumsum(first) - 1]
        trees = grow(codes.view(np.uint64), root)
        label = np.arange(len(codes))
        crowd = np.flatnonzero(np.bincount(root, minlength=len(codes))[root] > 1)
        for at in range(0, len(crowd), QUERIES):
            a, b = search(trees, crowd[at : at + QUERIES], radius)
            linked = a != b
            if linked.any():
                label = _merge(label, a[linked], b[linked])
        out = np.flatnonzero(label != np.arange(len(codes)))
        return pa.table({"a": pa.array(codes[out]), "b": pa.array(codes[label[out]])})

    return run


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b) join the classes that ``label`` gives so far."""
    a, b = label[a], label[b]
    apart = a != b
    return smallest_linked(len(label), a[apart], b[apart])[label] if apart.any() else label


def bands(mask: int, radius: int) -> list[int]:
    """The bits that ``mask`` leaves, in radius + 1 runs: codes within the radius that agree on the mask agree on one run too."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    cuts = [round(k * len(free) / (radius + 1)) for k in range(radius + 2)]
    return [sum(1 << i for i in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _banded(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint once for each band after its mask."""
        for batch in batches:
            codes, masks = (batch.column(c).to_numpy().view(np.uint64) for c in ("fp", "mask"))
            for mask in np.unique(masks).tolist():
                mine = codes[masks == mask]
                for band in bands(mask, radius):
                    new = np.full(len(mine), mask | band, np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (mine, new, mine & new)], names=["fp", "mask", "value"])

    return run


def shard_keys(codes: DataFrame, radius: int = RADIUS, most: int = TREE) -> DataFrame:
    """(fp, mask, value): the trees each distinct fingerprint enters, none of more than ``most``.

    A band value with too many fingerprints is split by the bands of its other
    bits, again and again. A mask that leaves b bits bounds its trees by 2**b, so
    the splitting ends after a few rounds (at ``radius`` bits at the latest).
    """
    keys, done = codes.select("fp", F.lit(0).cast("bigint").alias("mask")), None
    while True:
        keys = written(keys.mapInArrow(_banded(radius), "fp long, mask long, value long"), "bands")
        crowded = (F.col("count") > most) & (F.bit_count("mask") < BITS - radius)
        hot = written(keys.groupBy("mask", "value").count().where(crowded).select("mask", "value"), "hot-bands")
        if hot.isEmpty():
            return keys if done is None else done.unionByName(keys)
        cold = keys.join(hot, ["mask", "value"], "left_anti")
        done = cold if done is None else done.unionByName(cold)
        keys = keys.join(hot, ["mask", "value"], "left_semi").select("fp", "mask")


def links(codes: DataFrame, radius: int = RADIUS, most: int = TREE) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: links whose components are those of all pairs within the radius."""
    keys = written(shard_keys(codes, radius, most), "tree-keys")
    groups = max(512, math.ceil(keys.count() / GROUP_ROWS))
    grouped = keys.withColumn("trees", F.pmod(F.xxhash64("mask", "value"), F.lit(groups)))
    return grouped.groupBy("trees").applyInArrow(_links(radius), "a long, b long")


def classes(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per input row.

    Fingerprints at ``radius`` or fewer differing bits are linked, and a
    component is named by its smallest doc_id. Texts that are null, empty or
    without words have the fingerprint zero and are linked like any other;
    repeated rows keep their rows. A null doc_id names nothing: a component of
    such rows alone has a null component_id. Other columns are not read.
    """
    marked = written(fingerprints(docs, width), "fingerprints")
    codes = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    joined = components(links(codes, radius))
    named = codes.join(joined, codes.fp == joined.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = written(named, "components")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = written(named.join(least, "component").select("fp", "component_id"), "named")
    return marked.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
