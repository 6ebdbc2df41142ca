"""What has no default limit: long files, chunks, notes, names and embedded texts."""

from pyspark.sql import functions as F

from kgspark.operators import code as C
from kgspark.operators import documents as D
from kgspark.operators import notes as N
from kgspark.operators import web as W


def files(spark, *rows):
    return C.readable_files(spark.createDataFrame(list(rows), "repo string, path string, content string"))


def test_long_functions_are_found_by_their_end(spark):
    body = "\n".join(f"    x = step_{i}(x)" for i in range(40_000))
    src = files(spark, ("r", "a/long.py", f"def long(x):\n{body}\n    return last_word(x)\n"), ("r", "a/bad.py", "def broken(:\n"))
    nodes = C.python_file_symbols(src)
    assert {(r.entity_type, r.name) for r in nodes.collect()} == {("Function", "long"), ("Unparsed", "bad.py")}
    nodes = nodes.withColumn("entity_id", F.col("name"))
    text = C.symbol_chunks(nodes, src).filter("entity_id = 'long'").first().text
    assert text.endswith("last_word(x)") and len(text) > 500_000
    assert len(C.symbol_chunks(nodes, src, C.SHORT_PARTS).filter("entity_id = 'long'").first().text) < 2_000
    assert C.readable_files(src.select("repo", "path", "content"), 1000).count() == 1


def test_sql_statements(spark):
    sql = "create  table if not exists a_1 (id int);\nCREATE OR REPLACE VIEW v AS SELECT 1;\nCreate unique index i ON a_1 (id);\nCREATE FUNCTION f() RETURNS int;\nCREATE ROLE r;\nCREATE TABLE\n  b(x int);"
    got = C.sql_symbols(files(spark, ("r", "x.sql", sql)))
    assert [(r.entity_type, r.name, r.tag, r.line_start, r.signature) for r in got.orderBy("line_start").collect()] == [
        ("Class", "a_1", "table", 1, "CREATE TABLE a_1"), ("Class", "v", "view", 2, "CREATE VIEW v"), ("Function", "i", "index", 3, "CREATE INDEX i"),
        ("Function", "f", "sql_function", 4, "CREATE FUNCTION f"), ("Class", "b", "table", 6, "CREATE TABLE b")]


def test_notes_show_all_and_never_share_a_name(spark):
    deep = "a/" * 60
    text = "\n".join(f"line {i}" for i in range(200))
    src = files(spark, ("r", deep + "one.py", text), ("r", deep + "two.py", text), ("r", "s.py", "one"))
    notes = N.file_notes(src).collect()
    assert len({n.note_path for n in notes}) == 3 and all(len(n.note_path) <= len("Sources/GitHub/.md") + 80 for n in notes)
    assert all("line 199" in n.note for n in notes if "one_py" not in n.note_path and "s_py" not in n.note_path)
    assert "line 40" not in N.file_notes(src, preview=30).filter("note_path LIKE '%a_a%'").first().note and N.file_notes(src, least_lines=5).count() == 2
    pages = spark.createDataFrame([(f"r{i}", "T" * 80, "x.org", "evaluated") for i in (1, 2)] + [("r3", "Short  title", "x.org", "evaluated"), ("r4", "!!", "x.org", "evaluated")], "rid string, title string, domain string, status string")
    paths = {r.rid: r.note_path for r in W.ingest(pages).collect()}
    assert paths["r1"] != paths["r2"] and paths["r3"] == "Sources/Short title.md" and paths["r4"] == "Sources/x_org.md"


def test_embedded_text_is_whole(spark):
    df = spark.createDataFrame([("t", " ".join(f"w{i}" for i in range(3000)))], "title string, text string")
    row = df.select(D.embed_text(F.col("title"), F.col("text")).alias("whole"), D.embed_text(F.col("title"), F.col("text"), 500, 2000).alias("short")).first()
    assert row.whole.endswith("w2999") and row.whole.startswith("t\nw0 ") and len(row.short) == 2000
