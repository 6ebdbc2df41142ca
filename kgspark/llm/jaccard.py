"""Exact Jaccard join of shingle sets in metric space, and the components of its links.

Jaccard distance is a metric, so what is known about distances to a pivot bounds
all others. The join goes in steps that each keep every link:

1. Equal sets are one class (a digest of the sorted set); one member stands for it.
2. Two linked sets share enough of their smallest shingle hashes. Sets with too
   few such hashes in common with any other set are done.
3. Of the rest, a set can only link if as many of *all* its shingles as a link
   needs (``percent``) occur in other sets. For those that are left, the rarest shingles are the keys under which
   pivots find everything within reach. Of keys that the same sets hold, one is used.
   Seen from a key, what comes before and after it bounds what two sets share,
   and so do parity sketches of what each set may share at all. Sets that share
   several keys meet in one of them.
4. Levels of pivots: in each key with more than one component, the sets with the
   smallest random priority become pivots, eight times as many per level. Every
   other set of the key is compared with them. Sets belong to the Voronoi region
   of their nearest pivot; a set from outside is replicated into a region only as
   far as the triangle inequality allows a link with its members. Links merge
   components, sets of one component are not compared again, and a key is done
   when one component is left. So a large group of copies costs about its size,
   not its square.

Defined cases: null text or text without words has no shingles and links with
nothing. Fewer words than ``width`` are one shingle. Rows that repeat a doc_id are
members of their text's class each. A null doc_id gets its class's component and
names none unless all ids of the component are null. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.batches import erase, keyed, mix, same, text_chunks, unused, words_in, written
from kgspark.llm.exchange import BLOCK_BYTES, counts_in, merged, shared_keys
from kgspark.llm.graph import components

SHINGLE = 4
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Growth of the number of pivots per key from level to level.
GROWTH = 8


def shingle_sets(texts: list, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text (bytes; A-Z count as a-z)."""
    words, counts = (w := words_in([t.lower() if t else t for t in texts])).names, w.counts
    last = max(len(words) - width + 1, 0)
    code = mix(words[:last], 17)
    for k in range(1, width):
        code = mix(code * np.uint64(0x9E3779B97F4A7C15) + words[k : last + k], 17 + k)
    out = []
    at = 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(code[at : at + n - width + 1]).view(np.int64))
        elif n:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[at : at + n].tobytes(), seed=n)], np.uint64).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
        at += n
    return out


def named(s: np.ndarray) -> tuple[str, int]:
    """Digest of a set, and its first half as a number."""
    code = xxhash.xxh3_128_digest(s.tobytes())
    return code.hex(), int.from_bytes(code[:8], "big", signed=True)


def shared_at_least(n: int, percent: int = PERCENT) -> int:
    """Shingles that a set of n must have in common with any set it links with."""
    return -(-percent * n // 100)


def slack(n: int) -> int:
    """Shingles by which a prefix is longer than a link needs.

    Sets linked with one of n shingles have ``shared_at_least(n)`` or more, so
    1 + slack of that many of its prefix must be met again.
    """
    return n // 25


_PROFILE = ("block long, doc_id array<long>, text_key array<long>, n_shingles array<long>, digest array<string>, sig array<long>, "
            "needed array<int>, prefix array<array<long>>")


def _profiles(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block of documents: ids, set sizes and digests, and each set's prefix of smallest hashes."""
        task, seq, size = TaskContext.get().partitionId(), 0, 0
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        held: list[list] = [[] for _ in kinds]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([task << 24 | seq], pa.int64()), *(pa.array([h], pa.list_(k)) for h, k in zip(held, kinds))],
                names=["block", "doc_id", "text_key", "n_shingles", "digest", "sig", "needed", "prefix"])

        for part, texts in text_chunks(batches):
            for doc_id, key, text, s in zip(part.column("doc_id").to_pylist(), part.column("text_key").to_pylist(), texts, shingle_sets(texts, width)):
                least = shared_at_least(len(s), percent)
                row = (doc_id, key, len(s), *(named(s) if len(s) else (None, None)), 1 + slack(least),
                       s[: len(s) - least + 1 + slack(len(s))] if len(s) else s)
                for h, x in zip(held, row):
                    h.append(x)
                size += len(text or b"")
            if size >= BLOCK_BYTES:
                yield flush()
                held, size, seq = [[] for _ in kinds], 0, seq + 1
        if held[0]:
            yield flush()

    return run


def _hits(lists: pa.Array, known: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all lists, the document count of each, and where each list ends."""
    keys = lists.flatten().to_numpy().view(np.uint64)
    return keys, counts_in(keys, known, df), np.cumsum(pc.list_value_length(lists).to_numpy())


def _survivors(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Sets of a block that have as many shared keys in their prefix as a link needs."""
    known, df = merged(right)
    rows = []
    for c in range(left.num_rows):
        _, counts, ends = _hits(left.column("prefix")[c].values, known, df)
        hits = np.append(0, np.cumsum(counts > 1))
        hits = np.diff(hits[np.append(0, ends)])
        columns = [left.column(n)[c].as_py() for n in ("doc_id", "text_key", "digest", "sig", "needed")]
        rows += [r[:4] for r, h in zip(zip(*columns), hits.tolist()) if r[2] is not None and h >= r[4]]
    columns = list(zip(*rows)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64())
    return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["doc_id", "text_key", "digest", "sig"])


def _sets(width: int, marks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per block of the sets at marked spots: their names and shingles."""
        task, seq = TaskContext.get().partitionId(), 0
        sigs, sets, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task << 24 | seq], pa.int64()), pa.array([sigs], pa.list_(pa.int64())), pa.array([sets], pa.list_(pa.list_(pa.int64())))],
                                              names=["block", "sig", "shingles"])

        def chosen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                spot = batch.column("spot").to_numpy()
                yield batch.filter(pa.array((marks[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)))

        for _, texts in text_chunks(chosen()):
            found = [s for s in shingle_sets(texts, width) if len(s)]
            sigs += [named(s)[1] for s in found]
            sets += found
            size += sum(len(t or b"") for t in texts)
            if size >= BLOCK_BYTES:
                yield flush()
                sigs, sets, size, seq = [], [], 0, seq + 1
        if sigs:
            yield flush()

    return run


#: Bits of the marks for each chosen text, about, and of all marks at most.
MARK_BITS, MOST_BITS = 16, 1 << 26
#: Bits of one row of Spark's bitmap functions.
_BITMAP = 1 << 15


def spots(bits: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(bits))


def marked(chosen: DataFrame, bits: int) -> np.ndarray:
    """A bit for each spot of the chosen texts, packed: ``bits`` / 8 bytes, whatever the number of texts."""
    place = (spots(bits) + 1).cast("bigint")
    rows = chosen.select(F.bitmap_bucket_number(place).alias("row"), F.bitmap_bit_position(place).alias("at"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.groupBy("row").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        out[(r["row"] - 1) * (_BITMAP // 8) : r["row"] * (_BITMAP // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def _total(blocks: DataFrame, column: str) -> int:
    return blocks.agg(F.sum(F.aggregate(column, F.lit(0).cast("bigint"), lambda n, x: n + F.size(x)))).first()[0] or 0


def _near(docs: DataFrame, profiles: DataFrame, width: int) -> DataFrame:
    """Blocks of sets (block, sig, shingles) of the classes that may link, after the first filter."""
    answers = shared_keys(profiles, "prefix", _total(profiles, "prefix"))
    asked = profiles.select("block", "doc_id", "text_key", "digest", "sig", "needed", "prefix")
    near = asked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_survivors, "doc_id long, text_key long, digest string, sig long")
    # One text for each class, that of its smallest document.
    chosen = near.groupBy("digest", "sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_key")).alias("c"))
    chosen = written(chosen.select(F.col("c.doc_id").alias("doc_id"), F.col("c.text_key").alias("text_key")), "chosen")
    # Texts do not move: tasks that read them again know the chosen ones by marks. A text that shares its spot with
    # a chosen one comes along; it is one more set, which later filters see.
    bits = min(MOST_BITS, max(_BITMAP, 1 << (MARK_BITS * chosen.count()).bit_length()))
    texts = docs.select(spots(bits).cast("bigint").alias("spot"), "text")
    sets = written(texts.mapInArrow(_sets(width, marked(chosen, bits)), "block long, sig array<long>, shingles array<array<long>>"), "sets")
    erase(chosen)
    return sets


#: Words of 64 bits in a set's sketch.
SKETCH = 16
_SKETCH = [f"s{k}" for k in range(SKETCH)]
#: Keys of its set before a key that its row names at most.
EARLIER = 64


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each bit, whether an odd number of shingle hashes fall on it. Two sets differ in a shingle at least for each bit in which their sketches do."""
    bits = np.bincount(((shingles >> np.uint64(20)) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((bits & 1).astype(np.uint8)).view(np.int64)


def _prefixes(percent: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """(sig, n, common, sketch, keys): the rarest shared shingles of each set that can still link, as many as a link needs.

        ``common`` counts the set's shingles that may be in common with another set,
        of which the keys are the first in order; the sketch is that of all of them.
        """
        known, df = merged(right)
        rows, out = [np.empty((0, 3 + SKETCH), np.int64)], []
        for c in range(left.num_rows):
            keys, counts, ends = _hits(left.column("shingles")[c].values, known, df)
            for sig, a, b in zip(left.column("sig")[c].values.to_pylist(), np.append(0, ends)[:-1].tolist(), ends.tolist()):
                common = np.flatnonzero(counts[a:b] > 1)
                needed = shared_at_least(b - a, percent)
                if len(common) >= needed:
                    # Shingles of its own come first in the order; the prefix has n - needed + 1 in all.
                    order = np.lexsort((keys[a:b][common], counts[a:b][common]))
                    out.append(keys[a:b][common[order[: len(common) - needed + 1]]].view(np.int64))
                    rows.append(np.concatenate(([sig, b - a, len(common)], sketch(keys[a:b][common])))[None])
        rest = np.concatenate(rows)
        return pa.Table.from_arrays([*(pa.array(rest[:, k]) for k in range(3 + SKETCH)), pa.array(out, pa.list_(pa.int64()))],
                                    names=["sig", "n", "common", *_SKETCH, "keys"])

    return run


def _prefixed(blocks: DataFrame, percent: int) -> DataFrame:
    """One row per set that can still link."""
    answers = shared_keys(blocks, "shingles", _total(blocks, "shingles"))
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _prefixes(percent), ", ".join(f"{c} long" for c in ("sig", "n", "common", *_SKETCH)) + ", keys array<long>").dropDuplicates(["sig"])


def _one_of_alike(keys: DataFrame) -> DataFrame:
    """The rows of one key of all that the same sets hold, if they are more than one, and how many these are.

    Linked sets pass ``_may_link`` at each key they share, so one key finds the
    pairs that all of these would find.
    """
    holders = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor("sig").alias("a"), F.bit_xor(F.xxhash64("sig")).alias("b"))
    return keys.join(holders.where("size > 1").groupBy("size", "a", "b").agg(F.min("key").alias("key")).select("key", "size"), "key")


def _keys(sets: DataFrame) -> DataFrame:
    """(key, sig, n, common, sketch, before, earlier): a row for each key of each set.

    ``before`` counts the set's shared shingles before the key. ``earlier`` names keys
    of the set that fewer sets hold, the next ``EARLIER`` ones: sets that both
    name one meet there, and need not meet at this key.
    """
    alike = _one_of_alike(sets.select("sig", F.posexplode("keys").alias("before", "key")))
    lists = alike.groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("size", "key", "before"))).alias("held"))
    rows = lists.select("sig", "held", F.posexplode("held").alias("at", "one"))
    first = F.greatest(F.col("at") - EARLIER, F.lit(0))
    rows = rows.select(F.col("one.key").alias("key"), "sig", F.col("one.before").alias("before"),
                       F.slice(F.col("held.key"), first + 1, F.col("at") - first).alias("earlier"))
    return rows.join(sets.drop("keys"), "sig")


def _may_link(percent: int) -> Column:
    """Whether what two sets with a key in common can share reaches what a link of their sizes needs.

    A set shares at most what may be shared before and after the key. What two sets
    share is half of what is left of both without the shingles in which they
    differ, one at least for each bit that their sketches do not agree on.
    """
    def enough(twice: Column) -> Column:
        return (100 + percent) * twice >= 2 * percent * (F.col("n") + F.col("p_n"))

    def after(of: str) -> Column:
        return F.col(of + "common") - F.col(of + "before") - 1

    differing = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p_{c}"))) for c in _SKETCH), F.lit(0))
    return enough(2 * (F.least("before", "p_before") + 1 + F.least(after(""), after("p_")))) & enough(F.col("common") + F.col("p_common") - differing)


def _meetings(here: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """(y, p): pairs of a set and a pivot of one key that may link and are not in one component.

    The first key that two sets share has no earlier one, so there they meet, as
    soon as one of them is a pivot. Only two pivots of one key give two rows.
    """
    near = here.join(pivots, "key").where((F.col("label") != F.col("p_label")) & (F.col("sig") != F.col("p")) & _may_link(percent)
                                          & ~F.arrays_overlap("earlier", "p_earlier"))
    return near.select(F.greatest("sig", "p").alias("y"), F.least("sig", "p").alias("p"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(y, p, i, u): exact intersection and union sizes of the pairs."""
    a = sets.select(F.col("sig").alias("y"), F.col("n").alias("ny"), F.col("shingles").alias("sy"))
    b = sets.select(F.col("sig").alias("p"), F.col("n").alias("np"), F.col("shingles").alias("sp"))
    both = pairs.join(b, "p").join(a, "y")
    both = both.select("y", "p", (F.col("ny") + F.col("np")).alias("total"), F.size(F.array_intersect("sy", "sp")).alias("i"))
    return both.select("y", "p", "i", (F.col("total") - F.col("i")).alias("u"))


def links(blocks: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(sig, label): components of the linked sets; sets without a link may be missing. ``blocks`` is a written table, used up here."""
    spark = blocks.sparkSession
    reach = 1 - percent / 100 + 1e-9
    every = written(_prefixed(blocks, percent), "prefixes")
    keys = written(_keys(every), "few-keys")
    erase(every)
    # Only sets with keys are compared; a repeated row of one text may give a set twice.
    rows = blocks.select(F.inline(F.arrays_zip("sig", "shingles")))
    sets = written(rows.join(keys.select("sig").distinct(), "sig").select("sig", F.size("shingles").alias("n"), "shingles").dropDuplicates(["sig"]), "near-sets")
    erase(blocks)
    labels = written(keys.select("sig").distinct().withColumn("label", F.col("sig")), "labels")
    distances = spark.createDataFrame([], "y long, p long, d double")
    level, spent = 0, [keys]
    while True:
        here = keys.join(labels, "sig")
        undone = here.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
        here = written(here.join(undone, "key"), "open")
        erase(*spent)
        if here.isEmpty():
            break
        # A rank limit per key, which Spark applies before it shuffles.
        rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("sig"), "sig"))
        pivots = written(here.withColumn("rank", rank).where(F.col("rank") <= GROWTH**level).select(
            "key", F.col("sig").alias("p"), F.col("label").alias("p_label"), *[F.col(c).alias(f"p_{c}") for c in ("n", "common", "before", "earlier", *_SKETCH)]), "pivots")
        pairs = _meetings(here, pivots, percent).distinct()
        pairs = written(_window(pairs.join(distances, ["y", "p"], "left_anti"), distances, reach), "pairs")
        found = written(_verified(pairs, sets, percent).withColumn("d", 1 - F.col("i") / F.col("u")), "distances")
        linked = found.where(100 * F.col("i") >= percent * F.col("u"))
        named = linked.join(labels.select(F.col("sig").alias("y"), F.col("label").alias("a")), "y").join(
            labels.select(F.col("sig").alias("p"), F.col("label").alias("b")), "p")
        merged = components(named.select("a", "b"))
        labels = written(labels.join(merged.select(F.col("id").alias("label"), "component"), "label", "left").select(
            "sig", F.coalesce("component", "label").alias("label")), "labels")
        distances = distances.unionByName(found.select("y", "p", "d"))
        keys = here.drop("label").join(pivots.select("key", F.col("p").alias("sig")), ["key", "sig"], "left_anti")
        level, spent = level + 1, [here, pivots, pairs]
    erase(sets)
    return labels


def _window(pairs: DataFrame, distances: DataFrame, reach: float) -> DataFrame:
    """The pairs that the triangle inequality leaves.

    Both distances to a third set q, where known, may differ by the reach at
    most; q is the nearest pivot met so far of one of the two (its region).
    """
    both = distances.select("y", "p", "d").union(distances.select(F.col("p"), F.col("y"), F.col("d")))
    home = both.groupBy("y").agg(F.min_by("p", F.struct("d", "p")).alias("q"), F.min("d").alias("d_home"))
    placed = pairs.join(home.withColumnRenamed("y", "p"), "p", "left")
    known = both.select("y", F.col("p").alias("q"), F.col("d").alias("d_other"))
    placed = placed.join(known, ["y", "q"], "left")
    return placed.where(F.col("d_other").isNull() | (F.abs(F.col("d_other") - F.col("d_home")) <= reach)).select("y", "p")


def join(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id, one row per input row."""
    docs = keyed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    profiles = written(docs.mapInArrow(_profiles(width, percent), _PROFILE), "profiles")
    blocks = _near(docs, profiles, width)
    prefixes, profiles = profiles, written(profiles.select(F.inline(F.arrays_zip("doc_id", "text_key", "n_shingles", "digest", "sig"))), "members")
    erase(prefixes)
    labels = links(blocks, percent)
    classes = profiles.where("n_shingles > 0").groupBy("digest", "sig").agg(F.min("doc_id").alias("smallest"))
    named = written(classes.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig")), "classes")
    member = named.join(named.groupBy("label").agg(F.min("smallest").alias("component")), "label").select("digest", "component")
    out = profiles.select("doc_id", "text_key", "n_shingles", "digest").join(member, "digest", "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "text_key", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component (that of the smallest doc_id), and all rows without words."""
    found = join(docs, width, percent)
    key, keep_id, keep_key, wordless, times = unused(docs.columns, "text_key", "keep_id", "keep_key", "wordless", "times")
    stays = found.where((F.col("n_shingles") == 0) | same(F.col("doc_id"), F.col("component_id")))
    stays = stays.groupBy(F.col("doc_id").alias(keep_id), F.col("text_key").alias(keep_key)).agg(
        F.first(F.col("n_shingles") == 0).alias(wordless), F.count(F.lit(1)).alias(times))
    # Written, so that Spark knows its size; only rows that repeat are grouped.
    stays = written(stays, "stays")
    rows = docs.withColumn(key, F.xxhash64("text"))
    rows = rows.join(stays, same(F.col("doc_id").cast("bigint"), F.col(keep_id)) & (F.col(key) == F.col(keep_key)))
    lone = F.col(wordless) | (F.col(times) == 1)
    return rows.where(lone).unionByName(rows.where(~lone).dropDuplicates(["doc_id", key])).select(*docs.columns)
