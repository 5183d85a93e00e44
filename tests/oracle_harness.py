"""Run catalogue queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_harness.py [sf_dir] [name-substring ...]

The comparison mirrors the driver's: row count, column-name set, and an
order-insensitive multiset of rows (columns sorted by name; floats rounded).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from maieutic.plans.inputs import TABLES  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, _norm(x)) for k, x in v.asDict().items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = sdf.collect()
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return {"name": name, "status": "rows-only", "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    info = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(t1 - t0, 2),
            "duck_s": round(t2 - t1, 2)}
    if sorted(scols) != sorted(dcols):
        info["status"] = f"COLUMNS differ spark={sorted(scols)} duck={sorted(dcols)}"
        return info
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if a == b:
        info["status"] = "match"
    else:
        info["status"] = "VALUES differ"
        sa, sb = set(a), set(b)
        info["spark_only"] = [x for x in a if x not in sb][:3]
        info["duck_only"] = [x for x in b if x not in sa][:3]
    return info


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from maieutic.plans import catalog
    from maieutic.session import get_session

    spark = get_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, ors = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if pats and not any(p in name for p in pats):
            continue
        try:
            info = compare(spark, con, name, qs[name], ors.get(name), sf_dir)
        except Exception as e:  # report and go on
            info = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:600]}"}
        if info["status"] not in ("match", "rows-only"):
            bad += 1
        print(info, flush=True)
    print(f"done: {bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
