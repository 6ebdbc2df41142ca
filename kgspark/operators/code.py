"""Source files as a graph: symbols, edges, chunks and incremental scans.

Files are (repo, path, content). Symbols become rows of one table whatever the
language, so ids, edges and chunks are written once.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark import fixed
from kgspark.functions import text as X
from kgspark.functions.pycode import python_symbols
from kgspark.session import spread

_COLUMNS = ["repo", "path", "language", "entity_type", "name", "tag", "line_start", "line_end", "signature", "docstring",
            "params", "returns", "calls"]


def extension(path: Column) -> Column:
    return F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", -1))


def readable_files(files: DataFrame, max_chars: Optional[int] = None) -> DataFrame:
    """Files of known extensions outside skipped and hidden folders; with ``max_chars`` no longer ones."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    skipped = F.exists(folders, lambda d: d.isin(fixed.SKIPPED_FOLDERS) | d.startswith("."))
    known = fixed.CODE_EXTENSIONS + fixed.DOC_EXTENSIONS + fixed.OTHER_EXTENSIONS
    ext = extension(F.col("path"))
    return files.filter(
        (ext.isin(known) | F.col("path").endswith(".env.example")) & ~skipped & (F.lit(True) if max_chars is None else F.length("content") <= max_chars)
    ).withColumn("language", F.coalesce(F.element_at(X.literal_map(fixed.LANGUAGES), ext), ext))


def entity_id(repo: Column, path: Column, name: Column, tag: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", repo, path, name, tag), 256), 1, 16)


def edge_id(source: Column, kind: Column, target: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit("-"), kind, F.lit("->"), target), 256), 1, 16)


def code_uri(repo: Column, path: Column, name: Column) -> Column:
    return F.concat_ws(":", F.lit("code"), repo, path, name)


# What CREATE makes, the graph label and the id tag of each kind.
SQL_KINDS = {"TABLE": ("Class", "table"), "INDEX": ("Function", "index"), "VIEW": ("Class", "view"), "FUNCTION": ("Function", "sql_function")}
#: Words that may stand between CREATE, the kind and the name.
SQL_FILLERS = ["OR", "REPLACE", "UNIQUE", "IF", "NOT", "EXISTS"]


def _empty_detail(df: DataFrame) -> DataFrame:
    for c in ("docstring", "params", "returns"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df if "calls" in df.columns else df.withColumn("calls", F.array().cast("array<string>"))


def sql_symbols(files: DataFrame) -> DataFrame:
    """Tables, indexes, views and functions of SQL files with their line numbers.

    The text is cut before every CREATE; a piece's line is one more than the
    line breaks before it.
    """
    pieces = files.filter("language = 'sql'").select("repo", "path", "language", F.split("content", r"(?i)(?=CREATE\s)").alias("pieces"))
    breaks = F.transform("pieces", lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"), F.lit(""))))
    each = pieces.withColumn("breaks", breaks).select(
        "repo", "path", "language", "breaks", F.posexplode("pieces").alias("at", "piece")
    ).filter(F.col("piece").rlike(r"(?i)^CREATE\s"))
    # A statement is CREATE, fillers, a kind, fillers and a name; the first ten words hold all of them.
    said = F.filter(F.slice(F.split("piece", r"\s+", 11), 2, 9), lambda w: ~F.upper(w).isin(SQL_FILLERS))
    kind, name = F.upper(F.get(said, F.lit(0))), F.regexp_extract(F.get(said, F.lit(1)), r"^\w+", 0)
    label = lambda i: F.element_at(X.literal_map({k: v[i] for k, v in SQL_KINDS.items()}), kind)
    line = (F.aggregate(F.slice("breaks", F.lit(1), F.col("at")), F.lit(0), lambda a, b: a + b) + 1).cast("int")
    entry = F.struct(label(0).alias("entity_type"), name.alias("name"), label(1).alias("tag"), F.concat(F.lit("CREATE "), kind, F.lit(" "), name).alias("signature"))
    found = F.when(label(0).isNotNull() & (name != ""), entry)
    out = each.withColumn("s", found).filter("s IS NOT NULL").select(
        "repo", "path", "language", "s.*", line.alias("line_start"), line.alias("line_end"))
    return _empty_detail(out).select(_COLUMNS)


# Patterns of declarations that start a line in TypeScript and JavaScript.
_SCRIPT = [
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)", "Class", "class"),
    (r"^\s*(?:export\s+)?(?:default\s+)?interface\s+(\w+)", "Interface", "interface"),
    (r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)", "Function", "function"),
    (r"^\s*(?:export\s+)?const\s+(\w+)(?:\s*:[^=]+)?\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)(?:\s*:[^=]+)?\s*=>", "Function", "arrow"),
    (r"^\s*import\b.*?['\"]([^'\"]+)['\"]", "Import", "import"),
]


def script_symbols(files: DataFrame) -> DataFrame:
    """Declarations of TypeScript / JavaScript files by line patterns (an approximation).

    A symbol ends where the next one of its file begins.
    """
    lines = files.filter(F.col("language").isin("typescript", "tsx", "javascript")).select(
        "repo", "path", "language", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    found = None
    for pattern, label, tag in reversed(_SCRIPT):
        name = F.regexp_extract("line", pattern, 1)
        entry = F.struct(F.lit(label).alias("entity_type"), name.alias("name"),
                         (F.concat(F.lit("import:"), name) if tag == "import" else F.lit(tag)).alias("tag"))
        found = F.when(name != "", entry) if found is None else F.when(name != "", entry).otherwise(found)
    hits = lines.withColumn("s", found).filter("s IS NOT NULL")
    # One file bounds the window group: files above the size limit were left out before.
    following = F.lead("at").over(Window.partitionBy("repo", "path").orderBy("at"))
    start = (F.col("at") + 1).cast("int")
    out = hits.select(
        "repo", "path", "language", "s.*", start.alias("line_start"),
        F.when(F.col("s.entity_type") == "Import", start).otherwise(F.coalesce(following, F.col("at") + 1)).cast("int").alias("line_end"),
        X.strip(F.col("line")).alias("signature"))
    return _empty_detail(out).select(_COLUMNS)


def python_file_symbols(files: DataFrame) -> DataFrame:
    """Imports, classes and functions; a file that does not parse gives one row of the type Unparsed."""
    found = spread(files.filter("language = 'python'")).select("repo", "path", "language", python_symbols("content").alias("s"))
    base, none = F.substring_index("path", "/", -1), F.lit("")
    failed = F.struct(
        F.lit("Unparsed").alias("entity_type"), base.alias("name"), F.lit("unparsed").alias("tag"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"),
        F.col("path").alias("signature"), none.alias("docstring"), none.alias("params"), none.alias("returns"), F.array().cast("array<string>").alias("calls"))
    return found.select("repo", "path", "language", F.inline(F.coalesce("s", F.array(failed)))).select(_COLUMNS)


def file_entities(files: DataFrame) -> DataFrame:
    """The File row of every file, and the Module row of code files."""
    base = F.substring_index("path", "/", -1)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    package = stem.isin("__init__", "index")
    module = F.when(package & (folder != ""), F.substring_index(folder, "/", -1)).when(package, F.col("repo")).otherwise(stem)
    dotted = F.when(folder == "", module).when(package & (F.col("language") == "python"), F.replace(folder, F.lit("/"), F.lit("."))).when(
        F.col("language") == "python", F.concat(F.replace(folder, F.lit("/"), F.lit(".")), F.lit("."), module)
    ).otherwise(F.concat(folder, F.lit("/"), module))
    size = F.size(F.split("content", "\n"))
    rows = F.array(
        F.struct(F.lit("File").alias("entity_type"), base.alias("name"), F.lit("file").alias("tag"), F.lit(1).alias("line_start"), size.alias("line_end"), F.col("path").alias("signature")),
        F.when(F.col("language").isin("python", "typescript", "tsx", "javascript"), F.struct(
            F.lit("Module").alias("entity_type"), module.alias("name"), F.lit("module").alias("tag"), F.lit(1).alias("line_start"), F.lit(1).alias("line_end"),
            F.concat(F.lit("module "), dotted, F.when(package, F.lit(" (package)")).otherwise(F.lit(""))).alias("signature"))),
    )
    out = files.select("repo", "path", "language", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("s")).select("repo", "path", "language", "s.*")
    return _empty_detail(out).select(_COLUMNS)


def symbols(files: DataFrame) -> DataFrame:
    """All code entities of the files with their ids and uris."""
    ready = readable_files(files)
    out = file_entities(ready).unionByName(python_file_symbols(ready)).unionByName(script_symbols(ready)).unionByName(sql_symbols(ready))
    repo, path, name = F.col("repo"), F.col("path"), F.col("name")
    return out.withColumn("entity_id", entity_id(repo, path, name, F.col("tag"))).withColumn("code_uri", code_uri(repo, path, name))


def raw_edges(nodes: DataFrame) -> DataFrame:
    """BELONGS_TO, CONTAINS and CALLS edges; calls name their target."""
    keys = ["repo", "path"]
    files = nodes.filter("entity_type = 'File'").select(*keys, F.col("entity_id").alias("file_id"))
    modules = nodes.filter("entity_type = 'Module'").join(files, keys).select(
        F.col("file_id").alias("from_id"), F.lit("BELONGS_TO").alias("edge_type"), F.col("entity_id").alias("target"), *keys, F.lit(1).alias("line"))
    # SQL files contain their tables only; indexes, views and functions get no edge.
    inner = nodes.filter(F.col("entity_type").isin("Class", "Function", "Interface") & ((F.col("language") != "sql") | (F.col("tag") == "table")))
    contains = inner.join(files, keys).select(
        F.col("file_id").alias("from_id"), F.lit("CONTAINS").alias("edge_type"), F.col("entity_id").alias("target"), *keys, F.col("line_start").alias("line"))
    calls = nodes.select(F.col("entity_id").alias("from_id"), F.lit("CALLS").alias("edge_type"), F.explode("calls").alias("target"), *keys, F.col("line_start").alias("line"))
    return modules.unionByName(contains).unionByName(calls)


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with a known source and target, and the skipped rest.

    The target is looked up by id, then by name, then by the last dotted part
    of the name. Names are reduced to one id each first, so a name shared by
    very many symbols is one row on the lookup side.
    """
    ids = nodes.select("entity_id").distinct()
    names = nodes.groupBy("name").agg(F.min("entity_id").alias("named_id"))
    last = F.when(F.col("target").contains("."), F.substring_index("target", ".", -1))
    looked = (
        edges.join(ids.select(F.col("entity_id").alias("from_id"), F.lit(True).alias("has_source")), "from_id", "left")
        .join(ids.select(F.col("entity_id").alias("target"), F.col("entity_id").alias("by_id")), "target", "left")
        .join(names.select(F.col("name").alias("target"), F.col("named_id").alias("by_name")), "target", "left")
        .withColumn("last", last)
        .join(names.select(F.col("name").alias("last"), F.col("named_id").alias("by_last")), "last", "left")
        .withColumn("to_id", F.coalesce("by_id", "by_name", "by_last"))
    )
    ok = F.col("has_source").isNotNull() & F.col("to_id").isNotNull()
    cols = ["from_id", "edge_type", "target", "to_id", "repo", "path", "line"]
    good = looked.filter(ok).select(*cols, F.when(F.col("by_id").isNotNull(), "id").when(F.col("by_name").isNotNull(), "name").otherwise("last").alias("found_by"))
    return good.withColumn("edge_id", edge_id(F.col("from_id"), F.col("edge_type"), F.col("to_id"))), looked.filter(~ok).select(*cols)


def sweep(stored: DataFrame, scanned: DataFrame, unchanged: DataFrame, run_id: str) -> DataFrame:
    """Nodes after a scan: those of this run, those of unchanged files, and other repositories'.

    Nodes of scanned repositories whose file was neither scanned nor unchanged go away.
    """
    repos = scanned.select("repo").unionByName(unchanged.select("repo")).distinct()
    kept_files = unchanged.select("repo", "path").join(scanned.select("repo", "path").distinct(), ["repo", "path"], "left_anti")
    carried = stored.join(kept_files, ["repo", "path"], "left_semi")
    others = stored.join(repos, "repo", "left_anti")
    return scanned.withColumn("run_id", F.lit(run_id)).unionByName(carried.withColumn("run_id", F.lit(run_id))).unionByName(others)


#: Characters of each part that are enough for most models, for those who want shorter chunks.
SHORT_PARTS = {"Signature": 300, "Docstring": 500, "Parameters": 200, "Source": 1500}


def symbol_chunks(nodes: DataFrame, files: DataFrame, cuts: Optional[dict[str, int]] = None) -> DataFrame:
    """One searchable chunk per function, class, module and interface; whole parts unless ``cuts`` limits some (as SHORT_PARTS)."""
    most = cuts or {}
    wanted = nodes.filter(F.col("entity_type").isin("Function", "Class", "Module", "Interface"))
    src = files.select("repo", "path", F.split("content", "\n").alias("rows"))
    body = F.array_join(F.slice("rows", F.greatest(F.col("line_start"), F.lit(1)), F.greatest(F.least(F.col("line_end"), F.size("rows")) - F.greatest(F.col("line_start"), F.lit(1)) + 1, F.lit(0))), "\n")
    cut = lambda title, c: F.substring(c, 1, most[title]) if title in most else c
    part = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(title + ": "), cut(title, c)))
    text = F.concat_ws(
        "\n", F.concat("entity_type", F.lit(": "), "name"), F.concat(F.lit("File: "), "path"), part("Signature", F.col("signature")),
        part("Docstring", F.col("docstring")), part("Parameters", F.col("params")), part("Returns", F.col("returns")),
        F.concat(F.lit("Source:\n"), cut("Source", body)))
    rid = F.concat(F.lit("github:"), "repo", F.lit(":"), "path", F.lit("#entity:"), "name")
    order = Window.partitionBy("repo", "path").orderBy("line_start", "entity_id")  # the symbols of one file
    return wanted.join(src, ["repo", "path"]).select(
        rid.alias("chunk_rid"), "repo", "path", "entity_id", F.row_number().over(order).cast("int").alias("chunk_index"), text.alias("text"))


def label_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(F.col("entity_type").alias("label")).agg(F.count("*").alias("n"))
