"""Run a registered query in Spark and its oracle SQL in DuckDB and compare them the
way the correctness gate does: columns sorted by name, rows order-insensitive."""

from __future__ import annotations

import math
import sys

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def compare(spark, name, fn, sql, sf_dir, con=None, show=5):
    con = con or duck(sf_dir)
    sdf = fn(spark, sf_dir)
    s_cols = sorted(sdf.columns)
    s_rows = sorted((tuple(_norm(r[c]) for c in s_cols) for r in sdf.collect()), key=repr)
    rel = con.execute(sql)
    d_cols_raw = [d[0] for d in rel.description]
    d_rows_raw = rel.fetchall()
    d_cols = sorted(d_cols_raw)
    idx = [d_cols_raw.index(c) for c in d_cols]
    d_rows = sorted((tuple(_norm(r[i]) for i in idx) for r in d_rows_raw), key=repr)
    ok = s_cols == d_cols and s_rows == d_rows
    if not ok:
        print(f"[{name}] MISMATCH cols spark={s_cols} duck={d_cols} rows {len(s_rows)} vs {len(d_rows)}", file=sys.stderr)
        ss, dd = set(s_rows), set(d_rows)
        for r in list(ss - dd)[:show]:
            print("  spark only:", r, file=sys.stderr)
        for r in list(dd - ss)[:show]:
            print("  duck  only:", r, file=sys.stderr)
    return ok, len(s_rows), len(d_rows)


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from quaestio.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("local[8]", 8)
    con = duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            n = fn(spark, sf).count()
            print(f"{name}: rows-only {n}")
            continue
        ok, a, b = compare(spark, name, fn, sqls[name], sf, con)
        bad += not ok
        print(f"{name}: {'OK' if ok else 'FAIL'} ({a} / {b})")
    print("failures:", bad)
