from pyspark.sql import functions as F

from kgspark.functions import text as X
from kgspark.operators import code as C
from kgspark.operators import extraction as P
from kgspark.operators import federation as N
from kgspark.operators import graph as G
from kgspark.operators import notes as O
from kgspark.operators import store as S
from kgspark.sources import files as R

NOTE = """---
"@type": "bkc:Practice"
bioregion:
  - "[[Bioregions/North Shore]]"
people: ["[[People/Ann Lee]]"]
documentedBy: "[[CaseStudies/Shore Case]]"
knows: Bob, Cy
activityStatus: alive
---

# Eel Count
"""


def vault(folder):
    (folder / "Practices").mkdir(parents=True)
    (folder / "Practices" / "Eel Count.md").write_text(NOTE)
    (folder / "Practices" / "Plain.md").write_text("no front matter")


def test_notes_to_edges(spark, tmp_path):
    vault(tmp_path)
    notes = R.read_notes(spark, str(tmp_path))
    rows = {r.name: r for r in notes.collect()}
    assert rows["Eel Count"].entity_type == "Practice" and rows["Eel Count"].path == "Practices/Eel Count.md" and rows["Plain"].fields is None
    names = [("North Shore", "Bioregion"), ("Shore Case", "CaseStudy"), ("Bob", "Person")]
    reg = spark.createDataFrame(names, "entity_text string, entity_type string").select(
        X.entity_uri(F.col("entity_text"), F.col("entity_type")).alias("uri"), "entity_text", "entity_type", F.lower("entity_text").alias("normalized_text"))
    links = spark.createDataFrame([], "document_rid string, entity_uri string, mention_count long")
    edges, pending = O.sync_relations(O.field_rows(notes), reg, links)
    me = rows["Eel Count"].entity_uri
    got = {(r.predicate, r.subject_uri == me) for r in edges.collect()}
    assert got == {("practiced_in", True), ("documents", False), ("knows", True)}
    assert {(r.predicate, r.raw_unknown_label, r.target_type_hint) for r in pending.collect()} == {("involves_person", "Ann Lee", "Person"), ("knows", "Cy", "Person")}
    assert G.symmetric_closure(edges).filter("predicate = 'knows'").count() == 2


def test_promotion_rules(spark):
    rows = [(1, "s1", "river network"), (2, "s2", "lake group"), (3, "s3", "lake group"), (4, "s4", "hill team")]
    pending = spark.createDataFrame([(i, s, None, "about", label, "object", None, "about") for i, s, label in rows],
                                    "pending_id int, subject_uri string, object_uri string, predicate string, raw_unknown_label string, unknown_side string, target_type_hint string, source_field string")
    new = spark.createDataFrame([("u1", "River Network", "Organization"), ("u2", "Lake Group", "Organization"), ("u3", "Hill Teams", "Organization")], "uri string, entity_text string, entity_type string")
    assert [(r.pending_id, r.object_uri) for r in O.promote_pending(pending, new).collect()] == [(1, "u1")]


def test_write_notes(spark, tmp_path):
    reg = spark.createDataFrame([("u1", "Ann", "Person", None), ("u2", "Shore", "Bioregion", 'A "big" shore')], "uri string, entity_text string, entity_type string, description string")
    edges = spark.createDataFrame([("u1", "located_in", "u2")], "subject_uri string, predicate string, object_uri string")
    links = spark.createDataFrame([("vault:Day.md", "u1"), ("web:w1", "u1"), ("github:o/r:x", "u1")], "document_rid string, entity_uri string")
    sources = spark.createDataFrame([("web:w1", "Sources/W.md")], "document_rid string, note_path string")
    O.write_notes(O.note_lines(reg, edges, links, sources), str(tmp_path))
    assert (tmp_path / "People" / "Ann.md").read_text().split("\n") == [
        "---", '"@type": "schema:Person"', 'name: "Ann"', "location:", '  - "[[Bioregions/Shore]]"', 'uri: "u1"', "mentionedIn:", '  - "[[Day]]"', '  - "[[Sources/W]]"', "---", "",
        "# Ann", "", "## Relationships", "", "- located in: [[Bioregions/Shore]]", "", "## Mentioned In", "", "- [[Day]]", "- [[Sources/W]]", ""]
    shore = (tmp_path / "Bioregions" / "Shore.md").read_text()
    assert 'description: "A \\"big\\" shore"' in shore and "- located in (from): [[People/Ann]]" in shore
    # Ann's note has six body lines, Shore's four, the last one a single line.
    ann = (tmp_path / "People" / "Ann.md").read_text()
    stub = spark.createDataFrame([(ann,), (shore,), ("---\na: b\n---\n# x\n",)], "t string").select(O.is_stub(F.col("t")).alias("s")).collect()
    assert [r.s for r in stub] == [False, True, True]


def test_repository(spark, tmp_path):
    for path, text in {"a/x.py": "def f():\n    return g()\n", "node_modules/y.py": "", ".hid/z.py": "", "b.bin": "", "a/q.sql": "create\ntable t(x int);\nCREATE VIEW v AS\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = R.read_repository(spark, str(tmp_path), "o/r")
    assert {(r.path, r.language) for r in files.collect()} == {("a/x.py", "python"), ("a/q.sql", "sql")}
    nodes = C.symbols(files.select("repo", "path", "content"))
    assert {(r.entity_type, r.name, r.line_start) for r in nodes.filter("entity_type <> 'File'").collect()} == {("Module", "x", 1), ("Function", "f", 1), ("Class", "t", 1), ("Class", "v", 3)}
    good, skipped = C.resolve_edges(C.raw_edges(nodes), nodes)
    assert {r.edge_type for r in good.collect()} == {"BELONGS_TO", "CONTAINS"} and [r.target for r in skipped.collect()] == ["g"]
    chunk = C.symbol_chunks(nodes, files).filter("chunk_rid LIKE '%entity:f'").first()
    assert chunk.text == "Function: f\nFile: a/x.py\nSignature: def f()\nSource:\ndef f():\n    return g()"


def test_type_definitions_and_ontology(spark, tmp_path):
    (tmp_path / "schema-River.md").write_text("---\nlabel: River\nfolder: Rivers\nsimilarity_threshold: 0.7\n---\n")
    (tmp_path / "schema-Person.md").write_text("---\ntype_key: Person\nfolder: Humans\n---\n")
    (tmp_path / "schema-Clash.md").write_text("---\nlabel: Clash\nfolder: Concepts\n---\n")
    got = {r.name: (r.folder, r.jw_threshold) for r in R.read_type_definitions(spark, str(tmp_path)).collect()}
    assert got["River"] == ("Rivers", 0.7) and got["Person"] == ("Humans", 0.92) and "Clash" not in got and len(got) == 15
    (tmp_path / "o.jsonld").write_text('{"@graph": [{"@id": "x:A", "@type": "rdfs:Class", "rdfs:label": "A"}, {"@id": "x:p", "@type": "owl:ObjectProperty", "rdfs:label": {"@value": "p"}}]}')
    assert {(r.id, r.label) for r in R.read_ontology(spark, str(tmp_path / "o.jsonld")).collect()} == {("x:A", "A"), ("x:p", "p")}


def test_extraction(spark):
    text = '{"entities":[{"name":" A ","type":"person","fields":{"HQ":"x","Location":"y"}},{"name":""}],"relationships":[{"subject":"A","predicate":"builds-on","object":"B"},{"predicate":"eats"}]}'
    docs = spark.createDataFrame([(1, text), (2, "broken")], "id int, result string")
    e = P.entities(docs, ["id"]).collect()
    assert [(r.id, r.name, r.entity_type, r.confidence, r.fields) for r in e] == [(1, "A", "Person", 0.9, {"location": "y"})]
    assert [(r.subject, r.predicate, r.object) for r in P.relations(docs, ["id"]).collect()] == [("A", "builds_on", "B")]


def test_store(spark):
    df = lambda rows: spark.createDataFrame(rows, "k int, v string, o int")
    old, new = df([(1, "a", 1), (2, "b", 1)]), df([(2, "c", 2), (2, "d", 3), (3, None, 1), (3, "e", 2)])
    rows = lambda x: {(r.k, r.v) for r in x.collect()}
    assert rows(S.insert_ignore(old, new, ["k"], "o")) == {(1, "a"), (2, "b"), (3, None)}
    assert rows(S.upsert_latest(old, new, ["k"], "o")) == {(1, "a"), (2, "d"), (3, "e")}
    assert rows(S.upsert_latest(S.upsert_latest(old, new, ["k"], "o"), new, ["k"], "o")) == {(1, "a"), (2, "d"), (3, "e")}
    assert rows(S.coalesce_merge(old, df([(2, None, 5), (4, "x", 1)]), ["k"], ["v"])) == {(1, "a"), (2, "b"), (4, "x")}
    again = S.coalesce_merge(old, df([(2, "z", 5), (2, None, 6), (4, "x", 1)]), ["k"], ["v"], order="o").collect()
    assert {r.k: r.v for r in again} == {1: "a", 2: "z", 4: "x"} and len(again) == 3
    assert rows(S.replace_source(old, df([(2, "n", 1)]), "k")) == {(1, "a"), (2, "n")}


def test_edges_and_envelopes(spark):
    edges = spark.createDataFrame([("a", "knows", "b"), ("a", "knows", "a"), ("a", "Bad", "b"), ("a", None, "b"), (None, "knows", "b"), ("a", "flies", "b")], "subject_uri string, predicate string, object_uri string")
    good, bad = G.split_valid(edges)
    assert good.count() == 1 and {r.reason for r in bad.collect()} >= {"self loop", "bad predicate name", "unknown predicate", "missing endpoint", "missing predicate"}
    env = spark.createDataFrame([(1, "{}", "orn:koi-net.node:a+1", "me", "A" * 86 + "=="), (2, None, "x", "me", ""), (3, "{}", "x", "me", ""), (4, "{}", "orn:koi-net.node:a+1", "you", "")], "i int, p string, s string, t string, g string")
    got = {r.i: r.e for r in env.select("i", N.envelope_problem(F.col("p"), F.col("s"), F.col("t"), F.col("g"), "me").alias("e")).collect()}
    assert got == {1: None, 2: "missing payload", 3: "bad source", 4: "wrong target"}
