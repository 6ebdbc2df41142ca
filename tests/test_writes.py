"""Constraints, transactions and the bulk graph sink."""

import threading

import pytest
from pyspark.sql import functions as F

from kgspark.operators import constraints as C
from kgspark.operators import transaction as X
from kgspark.sources import graph_store as G
from kgspark.sources.shared_files import files_below


def reasons(found, table):
    good, bad = found[table]
    return {r.id: None for r in good.collect()} | {r.id: r.reason for r in bad.collect()}


def test_refused_parents_refuse_their_children(spark):
    parent = spark.createDataFrame([(1, "a", 5), (2, "b", -1), (3, "a", 7), (4, None, 1), (5, None, 2), (6, "old", 1), (7, "g", None)], "id long, name string, size int")
    child = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, None, None), (4, "old", 1), (5, "zzz", None), (6, "a", 2), (7, "a", 6), (8, "g", 9), (9, "a", 9)], "id long, name string, up long")
    stored = {"parent": spark.createDataFrame([(100, "old", 1)], "id long, name string, size int")}
    rules = [C.Rules("parent", ("id",), {"size": F.col("size") > 0}, [("name",)]),
             C.Rules("child", ("id",), references=[C.Reference(("name",), "parent", ("name",)), C.Reference(("up",), "child", ("id",))])]
    found = C.split({"parent": parent, "child": child}, stored, rules)
    assert reasons(found, "parent") == {1: None, 2: "check size", 3: "unique name", 4: None, 5: None, 6: "unique name", 7: None}
    # 5 has no parent; 2 falls with its parent, 6 with 2, 7 with 6; 8 refers to a later row that refers to itself.
    assert reasons(found, "child") == {1: None, 2: "foreign key name", 3: None, 4: None, 5: "foreign key name", 6: "foreign key up", 7: "foreign key up", 8: None, 9: None}


def test_a_refused_row_holds_no_key(spark):
    """The first row of a key is refused by a check, so the second takes the key; several keys, a hot one."""
    rows = spark.createDataFrame([(1, "a", "x", False), (2, "a", "y", True), (3, "a", "z", True), (4, "b", "y", True)] + [(10 + i, "hot", f"h{i}", True) for i in range(50)], "id long, k string, j string, ok boolean")
    found = C.split({"t": rows}, {}, [C.Rules("t", ("id",), {"ok": F.col("ok")}, [("k",), ("j",)])])
    got = reasons(found, "t")
    assert {i: got[i] for i in (1, 2, 3, 4)} == {1: "check ok", 2: None, 3: "unique k", 4: "unique j"}
    assert [i for i in got if i >= 10 and got[i] is None] == [10]
    assert C.split({"t": rows.limit(0)}, {}, [C.Rules("t", ("id",), {}, [("k",)])])["t"][0].count() == 0


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "n long")


def values(tables, name):
    return sorted(r.n for r in tables.read(name).collect())


def test_losing_and_failing_writers_leave_all_tables(spark, tmp_path):
    tables = X.Tables(spark, f"{tmp_path}/t")
    with tables.begin() as tx:
        tx.write("a", numbers(spark, 1))
        tx.write("b", numbers(spark, 2))
    one, two, reader, beside = tables.begin(), tables.begin(), tables.begin(), tables.begin()
    assert reader.read("b").count() == 1
    one.write("a", one.read("a").unionByName(numbers(spark, 3)))
    two.write("b", two.read("b").unionByName(two.read("a")))
    beside.write("c", numbers(spark, 9))
    assert one.commit() == 2 and beside.commit() == 3
    with pytest.raises(X.Conflict, match="a"):
        two.commit()  # it read what has changed
    reader.write("d", reader.read("b"))
    assert reader.commit() == 4
    with pytest.raises(ZeroDivisionError):
        with tables.begin() as tx:
            tx.write("a", numbers(spark))
            tx.write("b", numbers(spark))
            1 / 0
    assert values(tables, "a") == [1, 3] and values(tables, "b") == [2] and values(tables, "c") == [9] and tables.version() == 4
    with tables.begin() as tx:
        tx.write("a", numbers(spark, 4))
        mark = tx.savepoint()
        tx.write("b", numbers(spark, 5))
        assert sorted(r.n for r in tx.read("b").collect()) == [5]
        tx.rollback(mark)
    assert values(tables, "a") == [4] and values(tables, "b") == [2]
    assert values(tables, "a") != sorted(r.n for r in tables.read("a", 2).collect()) == [1, 3]
    tables.vacuum(keep=1)
    assert values(tables, "a") == [4] and len({n.split("/")[0] for n in files_below(f"{tmp_path}/t/data")}) == 4


def test_two_writers_at_once(spark, tmp_path):
    """Of writers that add to one table each wins a round; nothing is lost."""
    tables = X.Tables(spark, f"{tmp_path}/t")
    with tables.begin() as tx:
        tx.write("a", numbers(spark, 0))
    lost = []

    def work(k):
        while True:
            tx = tables.begin()
            tx.write("a", tx.read("a").unionByName(numbers(spark, k)).coalesce(1))
            try:
                tx.commit()
                return
            except X.Conflict:
                lost.append(k)

    threads = [threading.Thread(target=work, args=(k,)) for k in (1, 2, 3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert values(tables, "a") == [0, 1, 2, 3] and tables.version() == 4


def test_graph_store(spark, tmp_path):
    path = f"{tmp_path}/g"
    nodes = spark.createDataFrame([(f"n{i}", f"name {i}") for i in range(40)], "uri string, entity_text string")
    edges = spark.createDataFrame([(f"n{i}", "knows", f"n{(i * 7) % 40}", 0.5) for i in range(40)] + [("n1", "knows", "n7", 0.9), ("n1", "knows", "gone", 0.1), (None, "knows", "n1", 0.1)],
                                  "subject_uri string, predicate string, object_uri string, confidence double")
    refused = G.load_graph(nodes, edges, path, 8)
    assert sorted(r.reason for r in refused.filter("object_uri = 'gone' OR subject_uri IS NULL").collect()) == ["check triple", "foreign key object_uri"]
    assert {r.reason for r in refused.collect()} == {"check triple", "foreign key object_uri", "check self loop"}
    files = files_below(path)
    manifest = G._manifest(path)
    G.load_graph(nodes, edges, path, 99)
    assert files_below(path) == files and G._manifest(path) == manifest
    assert len(manifest["out"]) <= 8 and manifest["buckets"] == 8
    around = G.neighbours(spark, path, "n1")
    want = {(f"n{7}", "out")} | {(f"n{i}", "in") for i in range(40) if (i * 7) % 40 == 1 and i != 1}
    assert {(r.other_uri, r.direction) for r in around.collect()} == want
    assert len(around.inputFiles()) == 2
    out = G.read_table(spark, path, G.OUT)
    assert out.filter("subject_uri = 'n1'").select("confidence").first()[0] == 0.9
    # A later load changes the buckets it touches, and only those.
    G.load_graph(nodes.limit(0), spark.createDataFrame([("n3", "knows", "n4", 0.7)], edges.schema), path)
    after = G._manifest(path)
    assert sum(after["out"][b] != manifest["out"].get(b) for b in after["out"]) == 1 and after["nodes"] == manifest["nodes"]
    assert G.read_table(spark, path, G.OUT).count() == out.count() + (0 if (3 * 7) % 40 == 4 else 1)
