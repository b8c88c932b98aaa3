"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]

Per query: row count, column names (sorted) and an order-insensitive
comparison of values (doubles rounded to 6 decimals, timestamps as text).
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

import duckdb
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm_value(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, (pd.Timestamp,)):
        return str(v.tz_localize(None) if v.tzinfo else v)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, tuple)):
        return tuple(_norm_value(x) for x in v)
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return _norm_value(v.item())
        if isinstance(v, np.ndarray):
            return tuple(_norm_value(x) for x in v.tolist())
    except ImportError:
        pass
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def normalise(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    rows = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm_value(v) for v in rec))
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from reelsight.session import get_session
    import __spark_entry__ as entry

    spark = get_session("local[8]", 8)
    qs, oracles = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    report = {}
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            spdf = sdf.toPandas()
        except Exception as exc:  # noqa: BLE001
            report[name] = {"status": "spark-error", "error": str(exc)[:400]}
            print(name, report[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in oracles:
            report[name] = {"status": "no-oracle", "rows": len(spdf), "spark_s": round(ts, 2)}
            print(name, report[name], flush=True)
            continue
        try:
            dpdf = con.execute(oracles[name]).df()
        except Exception as exc:  # noqa: BLE001
            report[name] = {"status": "duck-error", "error": str(exc)[:400]}
            print(name, report[name], flush=True)
            continue
        res = {"rows_spark": len(spdf), "rows_duck": len(dpdf), "spark_s": round(ts, 2)}
        if sorted(spdf.columns) != sorted(dpdf.columns):
            res["status"] = "schema-mismatch"
            res["spark_cols"] = sorted(spdf.columns)
            res["duck_cols"] = sorted(dpdf.columns)
        elif len(spdf) != len(dpdf):
            res["status"] = "rowcount-mismatch"
        else:
            a, b = normalise(spdf), normalise(dpdf)
            if a == b:
                res["status"] = "match"
            else:
                res["status"] = "value-mismatch"
                diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
                res["first_diffs"] = [str(d)[:300] for d in diffs]
        report[name] = res
        print(name, res, flush=True)
    ok = sum(1 for r in report.values() if r["status"] in ("match", "no-oracle"))
    print(json.dumps({"ok": ok, "total": len(report)}))
    return 0 if ok == len(report) else 1


if __name__ == "__main__":
    raise SystemExit(main(sys.argv))
