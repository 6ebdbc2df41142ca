"""Tables with repeated addresses and names, and rounds that use all of their input."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark import plans
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """The smallest tables with every page submitted twice, under one address."""
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    out = str(tmp_path_factory.mktemp("twice"))
    for name in os.listdir(SF):
        if name.endswith(".parquet") and name != "pages.parquet":
            copy = shutil.copytree if os.path.isdir(f"{SF}/{name}") else shutil.copy
            copy(f"{SF}/{name}", f"{out}/{name}")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    again = pages.withColumn("page_id", F.col("page_id") + 25_000_000)
    pages.unionByName(again).write.parquet(f"{out}/pages.parquet")
    return out


def test_pages_of_one_address_are_one_document(spark, twice):
    ok, note = compare(spark, connect(twice), twice, "mention_totals", plans.QUERIES["mention_totals"], plans.ORACLES["mention_totals"])
    assert ok, note


def test_compression_ranks_licenses(monkeypatch):
    from kgspark.llm import licenses

    for name, text in licenses.TEMPLATES.items():
        assert licenses.ranked(licenses.words("some words of a text " + text + " and of what follows"))[0][0] == name
    own = licenses.words("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.")
    assert [f.license for _, f in licenses.inspect(own)] == ["CC-BY-SA-4.0"]
    # Without what compression saves, the wording of another license that fits with one word missing would be taken.
    monkeypatch.setattr(licenses, "saving", lambda stretch, template: 0)
    assert [f.license for _, f in licenses.inspect(own)] == ["CC-BY-4.0"]


def test_every_round_uses_every_block(spark):
    from kgspark.llm import language_model as lm

    texts = [(i, " ".join(["red green", "blue black"][i % 2] for _ in range(20))) for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").coalesce(1)
    blocks = docs.mapInArrow(lm._packer(1_000_000), "block long, data binary").localCheckpoint()
    assert blocks.count() == 1
    b = lm.unpack(bytes(blocks.collect()[0]["data"]))
    names, counts = np.unique(b.names[b.ids], return_counts=True)
    top = np.append(lm.END, names[np.argsort(-counts)][:4])
    rows, kinds = lm.features(b, lm.classes_of(b, top))
    loss = lambda w: -lm.log_softmax(w, rows)[np.arange(len(kinds)), kinds].mean()
    one, two = lm.fit(blocks, top, 1), lm.fit(blocks, top, 2)
    assert loss(two) < loss(one) - 1e-3 < loss(np.zeros_like(one))


@pytest.mark.parametrize("threshold, other", [(0.3, True), (0.3, False), (0.88, False), (0.88, True)])
def test_nearest_vector_equals_all_pairs(spark, threshold, other):
    from kgspark.operators import similarity_join as J

    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(40, 8))
    vecs = np.concatenate([base, base[:15], base + 0.1 * rnd.normal(size=base.shape)]).astype(np.float32)
    rows = [(i, ["a b", "c/d", None][i % 20 // 9], [float(x) for x in v]) for i, v in enumerate(vecs)] + [(500, "a b", [0.0] * 8), (501, "a b", None)]
    df = spark.createDataFrame(rows, "id long, grp string, vec array<float>").repartition(3)
    pairs = J.cosine_pairs(df, df, threshold).collect()
    want = {}
    for r in pairs:
        if not other or r.left_id != r.right_id:
            want[r.left_id] = min(want.get(r.left_id, (1.0, 0)), (-r.score, r.right_id))
    got = {r.left_id: (-r.score, r.right_id) for r in J.cosine_nearest(df, df, threshold, other).collect()}
    assert got == want and want
    assert J.cosine_nearest(df, df.filter("id < 0"), threshold).count() == 0


def test_a_round_of_admission_folds_chunks(spark, monkeypatch):
    """Steady traffic above the limit, where every start depends on the one before: rounds stay at the root of the segments."""
    from kgspark.operators import admission as A

    written = []
    real = A.cut_lineage
    monkeypatch.setattr(A, "cut_lineage", lambda df, label: written.append(label) or real(df, label))
    df = spark.range(1600).selectExpr("id", "'u' || id % 7 AS who", "timestamp_seconds(id * 97) AS at")
    got = A.admit(df, "who", "at", "id", 5, 20, segment_rows=100)
    assert got.count() == 1600 and got.filter("verdict = 'ok'").count() > 500
    assert written.count("folded") == 1 and written.count("starts") <= 6


def test_closure_keeps_only_its_last_tables(spark, tmp_path, monkeypatch):
    from kgspark import session
    from kgspark.operators import traversal as V

    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    ring = spark.range(12).selectExpr("id AS from_id", "(id + 1) % 12 AS to_id")
    got = V.closure(ring)
    assert got.count() == 144 and got.agg(F.max("hops")).first()[0] == 12
    assert len([d for d in os.listdir(tmp_path) if d.startswith("closure-")]) == 1
    assert len([d for d in os.listdir(tmp_path) if d.startswith("power-")]) <= 1
