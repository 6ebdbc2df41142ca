"""Symbols of Python source files, read with the standard library's parser."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

SYMBOL = StructType(
    [StructField(n, StringType()) for n in ("entity_type", "name", "tag")]
    + [StructField(n, IntegerType()) for n in ("line_start", "line_end")]
    + [StructField(n, StringType()) for n in ("signature", "docstring", "params", "returns")]
    + [StructField("calls", ArrayType(StringType()))]
)


def _symbols(source: str) -> list[tuple]:
    tree = ast.parse(source)
    lines = source.split("\n")
    out = []
    for node in ast.walk(tree):
        span = (getattr(node, "lineno", 1), getattr(node, "end_lineno", 1))
        if isinstance(node, ast.Import):
            out += [("Import", a.name, "import:" + a.name, *span, lines[span[0] - 1].strip(), "", "", "", []) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            name = "." * node.level + (node.module or "")
            out.append(("Import", name, "import:" + name, *span, lines[span[0] - 1].strip(), "", "", "", []))
        elif isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            is_class = isinstance(node, ast.ClassDef)
            params = "" if is_class else ast.unparse(node.args)
            returns = "" if is_class or node.returns is None else ast.unparse(node.returns)
            calls = [] if is_class else sorted({ast.unparse(c.func) for c in ast.walk(node) if isinstance(c, ast.Call)})
            out.append(("Class" if is_class else "Function", node.name, "class" if is_class else "function", *span,
                        lines[span[0] - 1].strip().rstrip(":"), ast.get_docstring(node) or "", params, returns, calls))
    return sorted(out, key=lambda s: s[3])


@F.pandas_udf(ArrayType(SYMBOL))
def python_symbols(source: pd.Series) -> pd.Series:
    """Imports, classes and functions of each file; null when it does not parse."""

    def read(text):
        try:
            return [dict(zip(SYMBOL.names, s)) for s in _symbols(text)]
        except (SyntaxError, ValueError, TypeError, RecursionError):
            return None

    return source.map(read)
