"""Run registered Spark queries and their DuckDB oracles side by side.

    python tests/oracle_check.py [sf_dir] [name ...]

Compares column names, row counts and order-insensitive values (doubles
compared after rounding to 6 decimals, with a 1e-6 tolerance).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if math.isinf(v):
            return v
        return round(v, 5)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import pandas as pd
        if v is pd.NA or v is pd.NaT:
            return None
    except Exception:
        pass
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return float(v)
    return v


def rows(df, cols):
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def close(a, b) -> bool:
    if len(a) != len(b):
        return False
    for x, y in zip(a, b):
        if isinstance(x, float) and isinstance(y, float):
            if not (math.isclose(x, y, abs_tol=2e-5) or x == y):
                return False
        elif x != y:
            return False
    return True


def check(spark, con, name: str, sf_dir: str, queries, oracle) -> tuple[bool, str, float]:
    t0 = time.time()
    sdf = queries[name](spark, sf_dir).toPandas()
    t1 = time.time() - t0
    if name not in oracle:
        return True, f"rows-only ({len(sdf)} rows)", t1
    odf = con.execute(oracle[name]).df()
    sc, oc = sorted(sdf.columns), sorted(odf.columns)
    if sc != oc:
        return False, f"columns differ: spark={sc} oracle={oc}", t1
    if len(sdf) != len(odf):
        return False, f"row count spark={len(sdf)} oracle={len(odf)}", t1
    a, b = rows(sdf, sc), rows(odf, sc)
    bad = [(x, y) for x, y in zip(a, b) if not close(x, y)]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} oracle={bad[0][1]}", t1
    return True, f"ok ({len(sdf)} rows)", t1


def main(argv: list[str]) -> int:
    from tastebud.session import get_session
    import __spark_entry__ as ent
    sf_dir = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv if not a.startswith("/")]
    spark = get_session("local[8]")
    qs, orc = ent.queries(), ent.oracle_sql()
    con = duck(sf_dir)
    failed = 0
    for n in names or sorted(qs):
        try:
            ok, msg, t = check(spark, con, n, sf_dir, qs, orc)
        except Exception as exc:  # report and continue
            ok, msg, t = False, f"ERROR {type(exc).__name__}: {str(exc)[:300]}", 0.0
        failed += not ok
        print(f"{'PASS' if ok else 'FAIL'} {n:32s} {t:6.2f}s {msg}", flush=True)
    print(f"{len(names or qs) - failed}/{len(names or qs)} passed; {sum(1 for n in (names or qs) if n in orc)} with oracle")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
