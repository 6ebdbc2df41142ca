import random

import pytest
from pyspark.sql import functions as F

from kgspark.functions import similarity as S
from kgspark.operators import similarity_join as J


def plain_jw(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = set(), []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(i + reach + 1, len(b))) if j not in taken and b[j] == ch), None)
        if j is not None:
            taken.add(j)
            left.append(ch)
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, [b[j] for j in sorted(taken)]))
    jaro = (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3
    head = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + head * 0.1 * (1 - jaro)


def noisy(rng, n, types):
    base = ["red plate", "blue ring", "herring monitoring", "customer#000000012", "nation 0", "x", "ab", "paul", "shawn anderson"]
    out = set()
    while len(out) < n:
        s = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(s) or 1)
            if rng.random() < 0.5 and s:
                s.pop(min(i, len(s) - 1))
            else:
                s.insert(i, rng.choice("abcde 01#"))
        if s:
            out.add((rng.choice(types), "".join(s)))
    return sorted(out)


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(5)
    limits = {"A": 0.92, "B": 0.75, "C": 0.85}
    left, right = noisy(rng, 200, "ABC"), noisy(rng, 200, "ABC")
    return left, right, limits


def test_scores(spark):
    pairs = [("hello", "hello"), ("herring monitoring", "herring monitring"), ("apple", "zebra"), ("", "x"), ("herring", "herrings"), ("word", "two words"), ("ab", "ba")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", S.jaro_winkler("a", "b").alias("jw")).collect():
        assert r.jw == pytest.approx(plain_jw(r.a, r.b), abs=1e-12)
    row = df.filter("a = 'word'").select(S.trigram_similarity(F.col("a"), F.col("b")).alias("t"), S.indel_ratio("a", "b").alias("r")).first()
    assert row.t == pytest.approx(0.363636, abs=1e-6) and row.r == pytest.approx(800 / 13)


def test_name_join_finds_every_pair(spark, sides):
    left, right, limits = sides
    l = spark.createDataFrame([(g, t, limits[g]) for g, t in left], "grp string, txt string, jw double")
    r = spark.createDataFrame(right, "grp string, txt string")
    got = {(x.grp, x.left_txt, x.right_txt): x.score for x in J.jaro_winkler_pairs(l, r).collect()}
    want = {(g, a, b): plain_jw(a, b) for g, a in left for h, b in right if g == h and plain_jw(a, b) >= limits[g]}
    assert got.keys() == want.keys() and len(want) > 100
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_indel_and_trigram_joins_find_every_pair(spark, sides):
    left, right, _ = sides
    l, r = spark.createDataFrame(left, "grp string, txt string"), spark.createDataFrame(right, "grp string, txt string")
    both = l.join(r.withColumnRenamed("txt", "b"), "grp").withColumn("s", S.indel_ratio("txt", "b")).filter("s >= 80")
    assert {tuple(x)[:3] for x in J.indel_pairs(l, r, 80.0).collect()} == {(x.grp, x.txt, x.b) for x in both.collect()}
    texts = l.select("txt").distinct().join(r.select(F.col("txt").alias("b")).distinct(), F.lit(True))
    want = texts.filter(S.trigram_similarity(F.col("txt"), F.col("b")) >= 0.6 - 1e-9)
    assert {tuple(x)[:2] for x in J.trigram_pairs(l, r, 0.6).collect()} == {tuple(x) for x in want.collect()}


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_vector_join_finds_every_pair(spark, threshold):
    rng = random.Random(2)
    centre = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, i % 2, [c + rng.gauss(0, 0.4) for c in centre[i % 6]]) for i in range(150)]
    v = spark.createDataFrame(rows, "id int, grp int, vec array<double>")
    got = {(x.left_id, x.right_id) for x in J.cosine_pairs(v, v, threshold).collect()}

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    assert got == {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and cos(a[2], b[2]) > threshold}
