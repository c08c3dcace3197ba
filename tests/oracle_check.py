"""Run registered queries on Spark and their SQL oracles on DuckDB, compare.

Compares row count, column names, a coarse type class per column, and an
order-insensitive hash of the values.  Usage:
    python -m tests.oracle_check [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import sys
import time

import duckdb
import numpy as np
import pandas as pd

from rentlens.sources.tables import DRIVER_TABLES


def duck(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    out = con.execute(sql).df()
    # nullable integers as Spark's toPandas gives them: floats where one is null
    return out.astype({c: "float64" if out[c].hasnans else "int64" for c, t in out.dtypes.items() if isinstance(t, pd.Int64Dtype)})


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (np.floating,)):
        v = float(v)
        return None if math.isnan(v) else v
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None).isoformat()
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, np.ndarray):
        return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, float) and v.is_integer():
        return v
    return v


def _kind(s: pd.Series) -> str:
    k = s.dtype.kind
    if k in "iu":
        return "int"
    if k == "f":
        # pandas turns nullable ints into floats; look at the values
        vals = s.dropna()
        return "num"
    if k == "b":
        return "bool"
    if k == "M":
        return "ts"
    return "obj"


def digest(pdf: pd.DataFrame) -> tuple[list[str], str]:
    cols = sorted(pdf.columns)
    rows = [repr(tuple(_norm(v) for v in r)) for r in pdf[cols].itertuples(index=False, name=None)]
    rows.sort()
    return cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()


def compare(spark, name: str, sf_dir: str, fn, sql: str | None) -> dict:
    t0 = time.time()
    sp = fn(spark, sf_dir).toPandas()
    t_spark = time.time() - t0
    out = {"query": name, "spark_rows": len(sp), "spark_sec": round(t_spark, 2)}
    if sql is None:
        out["oracle"] = "rows-only"
        return out
    t0 = time.time()
    dk = duck(sql, sf_dir)
    out["duck_sec"] = round(time.time() - t0, 2)
    out["duck_rows"] = len(dk)
    sc, sh = digest(sp)
    dc, dh = digest(dk)
    out["rows_match"] = len(sp) == len(dk)
    out["schema_match"] = sc == dc
    norm = lambda t: "datetime64" if str(t).startswith("datetime64") else str(t)
    dtype_diff = {c: (norm(sp[c].dtype), norm(dk[c].dtype)) for c in sc if c in dk.columns
                  and norm(sp[c].dtype) != norm(dk[c].dtype)}
    out["dtype_match"] = not dtype_diff
    if dtype_diff:
        out["dtype_diff"] = dtype_diff
    out["hash_match"] = sh == dh
    if not out["hash_match"] and sc == dc:
        srows = {repr(tuple(_norm(v) for v in r)) for r in sp[sc].itertuples(index=False, name=None)}
        drows = {repr(tuple(_norm(v) for v in r)) for r in dk[dc].itertuples(index=False, name=None)}
        out["only_spark"] = sorted(srows - drows)[:3]
        out["only_duck"] = sorted(drows - srows)[:3]
    elif sc != dc:
        out["spark_cols"], out["duck_cols"] = sc, dc
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from rentlens.session import build_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    import os
    extra = {"spark.sql.session.timeZone": os.environ["CHECK_TZ"]} if os.environ.get("CHECK_TZ") else None
    spark = build_session(master="local[*]", extra={"spark.sql.shuffle.partitions": "8", **(extra or {})})
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for n in (names or list(qs)):
        try:
            r = compare(spark, n, sf_dir, qs[n], orc.get(n))
        except Exception as e:  # report and continue
            r = {"query": n, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        ok = (r.get("hash_match", r.get("oracle") == "rows-only") and r.get("dtype_match", True)
              and "error" not in r)
        bad += 0 if ok else 1
        print(("OK  " if ok else "BAD ") + repr(r), flush=True)
    print(f"{bad} failing of {len(names or qs)}")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
