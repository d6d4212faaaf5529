"""Local stand-in for the driver's correctness gate.

Runs every ``queries()`` entry on Spark and its ``oracle_sql()`` on DuckDB over
the same parquet directory, then compares row count, column names and an
order-insensitive hash of rounded values.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quarry.sources.tables import TABLES  # noqa: E402


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir, names=None):
    import __spark_entry__ as entry

    q = entry.queries()
    sql = entry.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    results = {}
    for name in names or list(q):
        t0 = time.time()
        try:
            df = q[name](spark, sf_dir)
            srows = df.collect()
            scols = df.columns
        except Exception as exc:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(exc).__name__}: {str(exc)[:300]}"
            print(name, results[name], flush=True)
            continue
        t1 = time.time()
        if name not in sql:
            results[name] = f"rows-only {len(srows)}"
            print(f"{name}: {results[name]} ({t1 - t0:.1f}s)", flush=True)
            continue
        try:
            rel = con.execute(sql[name])
            dcols = [d[0] for d in rel.description]
            drows = rel.fetchall()
        except Exception as exc:  # noqa: BLE001
            results[name] = f"DUCKDB ERROR {type(exc).__name__}: {str(exc)[:300]}"
            print(name, results[name], flush=True)
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        ok_n = len(srows) == len(drows)
        ok_v = ok_cols and _rows(scols, srows) == _rows(dcols, drows)
        status = "OK" if (ok_cols and ok_n and ok_v) else "MISMATCH"
        results[name] = status
        print(f"{name}: {status} rows={len(srows)}/{len(drows)} cols_ok={ok_cols} "
              f"({t1 - t0:.1f}s)", flush=True)
        if status != "OK":
            print("  spark cols", scols, "duck cols", dcols)
            a, b = _rows(scols, srows), _rows(dcols, drows)
            sa, sb = set(a), set(b)
            print("  only spark:", [r for r in a if r not in sb][:3])
            print("  only duck :", [r for r in b if r not in sa][:3])
    return results


if __name__ == "__main__":
    from quarry.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session()
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v not in ("OK",) and not v.startswith("rows-only")]
    print("SUMMARY", len(res), "checked,", len(bad), "bad:", bad)
