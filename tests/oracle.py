"""Run registered queries next to their SQL in DuckDB and compare rows, names and types.

    python tests/oracle.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

KINDS = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float",
         "string": "text", "boolean": "bool", "BIGINT": "int", "INTEGER": "int", "HUGEINT": "huge", "DOUBLE": "float",
         "FLOAT": "float", "VARCHAR": "text", "BOOLEAN": "bool", "TIMESTAMP": "time", "timestamp_ntz": "time",
         "timestamp": "time", "DATE": "date", "date": "date"}
STRICT = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
          "timestamp_ntz": "TIMESTAMP"}


def canon(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan") if math.isnan(v) else (2, repr(v + 0.0))
    if isinstance(v, int):
        return (3, v)
    return (4, str(v))


def connect(sf_dir):
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def compare(df, con, sql):
    """None when equal, else what differs."""
    cols = sorted(df.columns)
    got = sorted([tuple(canon(r[c]) for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()])
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} vs {sorted(rel.columns)}"
    types = dict(zip(rel.columns, map(str, rel.types)))
    for name, t in df.dtypes:
        if STRICT.get(t) != types[name]:
            return f"type of {name}: {t} vs {types[name]}"
    at = [rel.columns.index(c) for c in cols]
    want = sorted([tuple(canon(row[i]) for i in at) for row in rel.fetchall()])
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return f"{len(diff)} of {len(got)} rows differ, e.g. {cols}\n   spark {[x[1] for x in diff[0][0]]}\n   duck  {[x[1] for x in diff[0][1]]}"
    return None


def main():
    import __spark_entry__ as entry
    from plumbline.session import get_spark
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = get_spark(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    sqls, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        start = time.time()
        try:
            df = fn(spark, args.sf)
            problem = compare(df, con, sqls[name]) if name in sqls else (None if df.count() else "no rows")
            n = "" if name in sqls else "(rows only)"
        except Exception as e:  # report and go on
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", ""
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {n} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main()
