"""Compare queries with their SQL on one test set: ``python tests/check.py [folder] [name …]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row):
    return tuple((v is None, str(type(v)), repr(v)) for v in row)


def _clean(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, (list, tuple)):
        return tuple(_clean(x) for x in v)
    return v


def difference(df, con, sql: str) -> str | None:
    """None when both give the same rows, else a short account of what differs."""
    columns = sorted(df.columns)
    cursor = con.execute(sql)
    theirs_cols = [d[0] for d in cursor.description]
    if sorted(theirs_cols) != columns:
        return f"columns {columns} vs {sorted(theirs_cols)}"
    at = [theirs_cols.index(c) for c in columns]
    ours = [tuple(_clean(r[c]) for c in columns) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    theirs = [tuple(_clean(r[i]) for i in at) for r in cursor.fetchall()]
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    a, b = sorted(ours, key=_key), sorted(theirs, key=_key)
    for x, y in zip(a, b):
        for c, v, w in zip(columns, x, y):
            if v != w or type(v) is not type(w):
                return f"{c}: {v!r} vs {w!r} in {x} / {y}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    import __spark_entry__ as e
    from textgrade.session import local_session

    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, sql = e.queries(), e.oracle_sql()
    bad = 0
    if len(wanted) == 1 and wanted[0].startswith("from:"):
        every = list(queries)
        wanted = every[every.index(wanted[0][5:]) :]
    for name in wanted or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                found = difference(df, con, sql[name])
                status = "same" if found is None else f"DIFFERENT {found[:600]}"
            else:
                status = f"rows {df.count()}"
        except Exception as ex:  # a broken query must not hide the others
            status = f"FAILED {str(ex)[:900]}"
        bad += status.startswith(("DIFF", "FAIL"))
        print(f"@@ {name} {time.time() - start:.1f}s {status}", flush=True)
    print(f"@@ {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:]) and 1)
