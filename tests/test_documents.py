import pytest

from kgspark.functions.html import parse_page
from kgspark.operators import documents as D
from kgspark.operators import web as W


def bounds(rows):
    return [(r.start_token, r.end_token) for r in sorted(rows, key=lambda r: r.chunk_index)]


def test_sentence_chunks(spark):
    stop = lambda n, at: " ".join(f"w{i}." if i in at else f"w{i}" for i in range(1, n + 1))
    docs = spark.createDataFrame([(1, stop(560, {471})), (2, stop(1200, set(range(10, 1201, 10)))), (3, stop(900, set())), (4, "  short   text "), (5, "  ")], "doc_id int, text string")
    out = D.sentence_chunks(docs, ["doc_id"], keep_tail=False).collect()
    by = lambda k: [r for r in out if r.doc_id == k]
    assert bounds(by(1)) == [(0, 471)]
    assert bounds(by(2)) == [(0, 500), (450, 950), (900, 1200)]
    assert bounds(by(3)) == [(0, 500), (450, 900)]
    assert [(r.text, r.total_chunks) for r in by(4)] == [("short   text", 1)] and not by(5)
    kept = D.sentence_chunks(docs, ["doc_id"]).filter("doc_id = 1").collect()
    assert bounds(kept) == [(0, 471), (471, 560)]


@pytest.mark.parametrize("n, want", [(500, [(0, 500)]), (530, [(0, 500), (450, 530)]), (560, [(0, 500), (450, 560)]), (1000, [(0, 500), (450, 950), (900, 1000)])])
def test_fixed_chunks(spark, n, want):
    docs = spark.createDataFrame([(1, " ".join(["w"] * n))], "doc_id int, text string")
    assert bounds(D.fixed_chunks(docs, ["doc_id"]).collect()) == want


PAGE = """<html><head><title> My &amp; Page </title><meta name="Description" content="first"><meta property="og:description" content="second">
<meta name="keywords" content="a, b ,"><meta name="author" content="X"></head><body><nav><p>menu menu</p></nav>
<main><script>var p="</p>";</script><div>Outer text <p>inner words</p></div><p>inner words</p><p>tiny</p><p>Open para<p>Nested para</p>
<ul><li>first list entry</li><li>short</li></ul><footer><p>footer text</p></footer></main><p>outside text</p></body></html>"""


def test_page(spark):
    r = spark.createDataFrame([(PAGE,), (None,)], "html string").select(parse_page("html").alias("p")).select("p.*").collect()
    assert (r[0].title, r[0].description, r[0].keywords, r[0].author) == ("My & Page", "first", ["a", "b"], "X")
    assert r[0].content.split("\n") == ["# My & Page", "", "Outer text inner words", "Open para Nested para first list entry short", "- first list entry"]
    assert r[1].content == "" and r[1].title is None


def test_scan(spark):
    docs = spark.createDataFrame([(1, "We met Ann-Marie and the Red   River Delta team. Ann"), (2, "redriver delta"), (3, "RED RIVER DELTA!")], "doc_id int, text string")
    names = spark.createDataFrame([("Red River Delta", "u1", "Location"), ("Ann", "u2", "Person"), ("x", "u3", "Person"), ("Ann-Marie and the Red", "u4", "Claim")], "name string, uri string, entity_type string")
    got = {(r.doc_id, r.uri): (r.position, r.context) for r in W.scan_entities(docs, names).collect()}
    assert set(got) == {(1, "u2"), (1, "u4"), (3, "u1")}
    assert got[(3, "u1")] == (1, "RED RIVER DELTA!") and got[(1, "u2")][0] == 8
    long = spark.createDataFrame([(1, "a " * 60 + "Ann" + " b" * 60)], "doc_id int, text string")
    context = W.scan_entities(long, names).first().context
    assert context.startswith("...a") and context.endswith("b...") and "Ann" in context


def test_states(spark):
    subs = spark.createDataFrame([("r1", "previewed", "A: b/c!", "x.org"), ("r2", "ingested", None, "x.org"), ("r3", "previewed", "!!!", "y.org")], "rid string, status string, title string, domain string")
    decisions = spark.createDataFrame([("r1", True), ("r2", True), ("r3", True)], "rid string, accept boolean")
    got = {r.rid: (r.status, r.applied, r.note_path) for r in W.ingest(W.evaluate(subs, decisions)).collect()}
    assert got == {"r1": ("ingested", True, "Sources/A bc.md"), "r2": ("ingested", False, None), "r3": ("ingested", True, "Sources/y_org.md")}
