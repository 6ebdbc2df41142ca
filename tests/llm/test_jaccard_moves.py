"""What the Jaccard join moves: no texts, and one key of those that the same sets hold."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from kgspark.llm import jaccard
from tests.llm.test_llm import brute_components


@pytest.fixture(scope="module")
def rows():
    """Pairs of near copies on both sides of the threshold, exact copies, texts that share much but not enough, repeated and null rows."""
    rnd = random.Random(6)
    out = []
    for n in (60, 200, 400, 900):
        for changed in (0, 1, n // 60, n // 30, n // 25, n // 20):
            base = [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
            other = list(base)
            for k in rnd.sample(range(n), changed):
                other[k] = f"x{rnd.randint(0, 10**6)}"
            out += [" ".join(base), " ".join(other), " ".join(base[: n // 2])]
    out += ["", None, "a b", "A  b", " \n"]
    ids = rnd.sample(range(1000), len(out))
    rows = list(zip(ids, out))
    return rows + [rows[0], rows[5], (None, rows[1][1]), (rows[2][0], rows[3][1])]


def found(spark, rows):
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got)


@pytest.fixture
def tables(monkeypatch):
    """Rows and plans of the tables that the join writes."""
    seen, written = collections.defaultdict(list), jaccard.written

    def record(df, label):
        out = written(df, label)
        seen[label].append((out.count(), df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(jaccard, "written", record)
    return seen


def test_texts_stay(spark, rows, tables):
    assert found(spark, rows) == brute_components(rows)
    (_, plan), = tables["sets"]
    assert "MapInArrow" in plan and "Join" not in plan and "hashpartitioning" not in plan


def test_alike_keys_count_once(spark, tables):
    """Near copies of one text share a prefix of many keys; its pair meets in a few of them."""
    rnd = random.Random(2)
    rows = []
    for i in range(30):
        base = [f"v{rnd.randint(0, 10**6)}" for _ in range(400)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base[:-2], "y", f"z{i}"]))]
    assert found(spark, rows) == brute_components(rows)
    assert tables["open"][0][0] == 60 and len({c for _, _, c in brute_components(rows)}) == 30


@pytest.mark.parametrize("every", [True, False])
def test_marks(spark, rows, monkeypatch, every):
    """Texts that come along by a shared spot change nothing, even if all do; marks have every chosen text."""
    marked = jaccard.marked

    def given(chosen, bits):
        out = marked(chosen, bits)
        spots = {r[0] for r in chosen.select(jaccard.spots(bits)).collect()}
        assert set(np.flatnonzero(np.unpackbits(out, bitorder="little")).tolist()) == spots and spots
        return np.full_like(out, 255) if every else out

    monkeypatch.setattr(jaccard, "marked", given)
    assert found(spark, rows) == brute_components(rows)


def near_copies(groups, each):
    """Groups of texts made from one text each, with so many changes that some link and some do not."""
    rnd = random.Random(each)
    out = []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(300)]
        for _ in range(each):
            copy = list(base)
            for k in rnd.sample(range(300), rnd.randint(1, 10)):
                copy[k] = f"x{rnd.randint(0, 10**9)}"
            out.append((len(out), " ".join(copy)))
    return out


@pytest.fixture
def meetings(monkeypatch):
    """Rows that the join on keys makes, level by level."""
    seen, plain = [], jaccard._meetings

    def record(*args):
        out = plain(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_meetings", record)
    return seen


def test_near_copies_meet_once(spark, meetings):
    """Rows of the join on keys grow with the sets, not with the square of a group, nor with the keys that a pair shares."""
    made = []
    for each in (30, 120):
        rows = near_copies(2, each)
        assert found(spark, rows) == brute_components(rows)
        made.append(sum(meetings))
        meetings.clear()
    assert made[1] <= 8 * 240 and made[1] <= 6 * made[0], made


def test_short_lists_of_keys_lose_no_link(spark, monkeypatch):
    rows = near_copies(2, 25) + [(900 + k, f"a b c d {k} e f g h i") for k in range(6)]
    monkeypatch.setattr(jaccard, "EARLIER", 1)
    assert found(spark, rows) == brute_components(rows)


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 50, 700, 5000):
        for changed in (0, 1, 20, 400, 3000):
            a = np.unique(rnd.integers(0, 2**64, n, np.uint64))
            b = np.unique(np.append(a[changed:], rnd.integers(0, 2**64, changed, np.uint64)))
            bits = sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
            apart = len(np.setxor1d(a, b))
            assert bits <= apart and (apart > 100 or bits >= apart * 0.7)


def test_pipeline_stage_meets_once(spark, meetings):
    """The pipeline's width and percent too: one row a pair, not one for each key that it shares."""
    rows = near_copies(2, 60)
    kept = corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    shingles = [(i, set(zip(*(t.split()[k:] for k in range(corpus_pipeline.NEAR_WIDTH))))) for i, t in rows]
    least = {i: i for i, _ in rows}
    for x, (i, a) in enumerate(shingles):
        for j, b in shingles[:x]:
            if least[i] != least[j] and 100 * len(a & b) >= corpus_pipeline.NEAR_PERCENT * len(a | b):
                low, high = sorted((least[i], least[j]))
                least = {k: low if v == high else v for k, v in least.items()}
    assert sorted(r.doc_id for r in kept) == sorted(set(least.values()))
    assert sum(meetings) <= 8 * len(rows)
