"""Run registered queries against their SQL in DuckDB: python -m tests.oracle_check DIR [name ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _rows(pdf) -> Counter:
    cols = sorted(pdf.columns)
    out = Counter()
    for row in pdf[cols].itertuples(index=False, name=None):
        out[tuple(_cell(v) for v in row)] += 1
    return out


def _cell(v):
    if v is None or (isinstance(v, float) and v != v) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, float):
        return repr(v)
    if hasattr(v, "tolist"):
        return repr(v.tolist())
    return str(v)


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    t0 = time.time()
    got = fn(spark, sf_dir).toPandas()
    t1 = time.time()
    if sql is None:
        return True, f"rows only {len(got)} ({t1 - t0:.1f}s)"
    want = con.sql(sql).df()
    t2 = time.time()
    times = f"({t1 - t0:.1f}s spark, {t2 - t1:.1f}s sql)"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = _rows(got), _rows(want)
    if a != b:
        return False, (f"spark {len(got)} rows, sql {len(want)} rows {times}; only spark {list((a - b).items())[:3]}; "
                       f"only sql {list((b - a).items())[:3]}")
    return True, f"{len(got)} rows {times}"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as entry_module
    from kgspark.session import local_session

    spark = local_session("oracle-check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    bad = []
    for name in sys.argv[2:] or queries:
        try:
            ok, note = compare(spark, con, sys.argv[1], name, queries[name], oracles.get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        if not ok:
            bad.append(name)
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
