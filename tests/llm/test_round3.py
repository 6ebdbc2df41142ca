"""Fill-in-middle, hard negatives and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kgspark.llm import fim, hard_negatives, simhash
from kgspark.llm import queries as llm_queries
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and very long texts, ties, repeated rows, copies, near copies, sentinels and line ends of all kinds."""
    rnd = random.Random(8)
    base = [" ".join(f"w{rnd.randint(0, 300)}" for _ in range(n)) for n in (1, 2, 3, 40, 90, 600, 60000)]
    near = [base[5] + " tail", "HEAD " + base[5], base[5].upper()]
    lines = ["\n", "\n\n\n", "a\nb", "a\nb\n", "é\nü “x”\n\n漢字\r\nlast", "x <P> y\nz", "<S>", "a\n<M", "<\nP>\n<", "", None, "  \t\n", base[4].replace(" ", "\n")]
    texts = base + near + lines + [base[4], base[4], base[5].replace("w1 ", "w1\n\t ")]
    out = [(i * 5, t, "en") for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, base[3], None), (None, None, None), (-4, base[4], "en")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = ["n", "form", "FIM_Text", "fim_restored", "fp", "component_id", "fingerprint", "mask", "value", "id", "key"]
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)]).repartition(3).cache()


def test_rotation():
    rnd = random.Random(1)
    for size in (0, 1, 2, 7, fim.STEP * 2 + 3, fim.STEP * 5):
        data = rnd.randbytes(size)
        a, m, b = sorted(rnd.randint(0, size) for _ in range(3))
        buffer = bytearray(data)
        fim.rotate(buffer, a, m, b)
        assert bytes(buffer) == data[:a] + data[m:b] + data[a:m] + data[b:]
        fim.rotate(buffer, a, a + b - m, b)
        assert bytes(buffer) == data


def plain_fim(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    code = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(code[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("seed, rate, spm", [(7, 100, 50), (1, 60, 100), (2, 100, 0), (3, 0, 50)])
def test_fim(docs, rows, seed, rate, spm):
    out = fim.restore(fim.transform(docs, seed, rate, spm))
    got = out.collect()
    found = [(r.doc_id, r.fim_lines, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r["fim_text"]) for r in got]
    assert sorted(found, key=repr) == sorted((plain_fim(i, t, seed, rate, spm) for i, t, _ in rows), key=repr)
    assert sorted((repr((r.doc_id, r.fim_restored)) for r in got)) == sorted(repr((i, t or "")) for i, t, _ in rows)
    assert set(out.columns) == {c for c in docs.columns if c != "FIM_Text"} | {"fim_lines", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text"}


def plain_mine(rows, is_anchor, k=5, n=10, low=30, high=90):
    rows = [(v, lab, [int(np.floor(256 * x)) for x in e]) for v, e, lab in rows
            if v is not None and lab is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for v, lab, e in rows:
        if not is_anchor(v):
            continue
        scored = sorted((-sum(a * b for a, b in zip(e, f)), w, other) for w, other, f in rows if w != v)
        for s, w, _ in [x for x in scored if x[2] == lab][:k]:
            mine = [(t, u) for t, u, other in scored if other != lab and low * -s <= 100 * -t <= high * -s][:n]
            out += [(v, w, i, u, -s, -t) for i, (t, u) in enumerate(mine, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(0.05, 0.2, 8).tolist(), int(rnd.integers(0, 3))) for i in range(240)]
    rows += [(i, [0.3] * 8, i % 2) for i in range(240, 300)]  # ties, more than any task keeps
    rows += [(i, [0.0] * 8, i % 3) for i in range(300, 320)]  # zero scores
    rows += [rows[10], rows[10], rows[20], (None, [0.1] * 8, 1), (400, None, 1), (410, [0.1, None], 1), (420, [float("nan")] * 8, 1), (430, [float("inf")] * 8, 1)]
    return rows + [(440, [0.1] * 8, None), (450, [], 1), (460, [0.4, 0.4], 1), (470, [0.2] * 12, 0), (480, [-0.3] * 8, 2), (-20, [0.25] * 8, 2)]


@pytest.mark.parametrize("k, n, low, high", [(5, 10, 30, 90), (2, 3, 0, 100), (9, 1, 95, 96)])
def test_hard_negatives(spark, vectors, k, n, low, high):
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as score", "2 as slot", "3 as block", "'x' as rank")
    got = hard_negatives.mine(df.repartition(7), F.col("vec_id") % 10 == 0, k, n, low, high)
    assert sorted(tuple(r) for r in got.collect()) == plain_mine(vectors, lambda v: v % 10 == 0, k, n, low, high)


def test_large_components(spark):
    """Sums beyond the whole numbers a double holds stay exact."""
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randint(-(10**6), 10**6)) + rnd.random() for _ in range(4)], i % 2) for i in range(60)]
    got = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 10 == 0)
    want = plain_mine(rows, lambda v: v % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want and max(r[4] for r in want) > 2**53


def test_slots():
    assert hard_negatives.windows([10, 3, 0, -5], 30, 90) == [(3, 9), (1, 2), (0, 0)]
    slots = {0: [(9, 1), (8, 2)], 2: [(0, 5), (0, 6), (0, 7)]}
    assert hard_negatives.suffix_merge(slots, [10, 3, 0], 3, 30, 90) == [[(9, 1), (8, 2)], [], [(0, 5), (0, 6), (0, 7)]]
    score, ids = np.array([3, 5, 5, 5, 1]), np.array([1, 9, 4, 7, 2])
    assert hard_negatives.best(score, ids, 2).tolist() == [2, 3] and hard_negatives.best(score, ids, 9).tolist() == [2, 3, 1, 0, 4]


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, radius):
    label = {c: c for c in codes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ordered = sorted(codes)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= radius:
                label[max(find(a), find(b))] = min(find(a), find(b))
    return {c: find(c) for c in codes}


def test_simhash(docs, rows):
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.classes(docs).collect()), key=repr)
    codes = [plain_fingerprint(t) for _, t, _ in rows]
    root = plain_components(set(codes), 2)
    least = {}
    for (i, _, _), c in zip(rows, codes):
        if i is not None:
            least[root[c]] = min(i, least.get(root[c], i))
    assert got == sorted(((i, f"{c:016x}", least.get(root[c])) for (i, _, _), c in zip(rows, codes)), key=repr)
    assert len({c for _, _, c in got}) < len(rows) - 6


@pytest.mark.parametrize("radius, most", [(2, 4096), (2, 100), (1, 60), (0, 5), (3, 150)])
def test_trees_find_all_links(spark, radius, most):
    """Clusters whose bits differ little, so that trees must be split again and again when ``most`` is small."""
    rnd = random.Random(radius)
    codes = {rnd.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for centre in (rnd.getrandbits(64), 0):
        for _ in range(150):
            code = centre
            for _ in range(rnd.randint(0, 6)):
                code ^= 1 << rnd.choice(range(20))
            codes.add(code)
    signed = [(c - 2**64 if c >> 63 else c,) for c in codes]
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(spark.createDataFrame(signed, "fp long"), radius, most).collect()]
    assert all((a ^ b).bit_count() >= 0 and a in codes and b in codes for a, b in found)
    label = {c: c for c in codes}
    for _ in range(len(codes)):
        before = dict(label)
        for a, b in found:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    want = plain_components(codes, radius)
    groups = lambda m: sorted(sorted(c for c in codes if m[c] == x) for x in set(m.values()))
    assert groups(label) == groups(want)


def test_tree_is_that_of_insertion():
    rnd = np.random.default_rng(3)
    codes = rnd.integers(0, 2**12, 300).astype(np.uint64)
    codes = np.unique(codes)
    trees = simhash.grow(codes, np.zeros(len(codes), np.int64))
    children = [{} for _ in codes]
    for i in range(1, len(codes)):
        node = 0
        while True:
            d = int(codes[i] ^ codes[node]).bit_count()
            if d not in children[node]:
                children[node][d] = i
                break
            node = children[node][d]
    assert [{d: int(c) for d, c in enumerate(row) if c >= 0} for row in trees.child] == children
    a, b = simhash.search(trees, np.arange(len(codes)), 2)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(len(codes)) for j in range(len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 2}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, form int")
    assert fim.restore(fim.transform(docs)).count() == 0 and simhash.classes(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0).count() == 0
    none = spark.createDataFrame([(1, None, 1), (2, [1.0], None)], vectors.schema)
    assert hard_negatives.mine(none, F.col("vec_id") >= 0).count() == 0


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_hard_negatives"])
def test_sql(spark, name):
    ok, note = compare(spark, connect(SF), SF, name, llm_queries.QUERIES[name], llm_queries.ORACLES[name])
    assert ok, note
