"""Runs registered queries against their SQL: python -m tests.compare DIR [name ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd


def database(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    out = {}
    for c in sorted(df.columns):
        s = df[c]
        if pd.api.types.is_bool_dtype(s):
            out[c] = s.map(lambda v: '~' if v is pd.NA or v is None else str(bool(v)))
        elif pd.api.types.is_numeric_dtype(s):
            f = s.astype(float)
            out[c] = f.map(lambda v: "~" if np.isnan(v) else repr(round(v, 9) + 0.0))
        else:
            def text(v):
                if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)):
                    return "~"
                if isinstance(v, (int, float)) and not isinstance(v, bool):
                    return repr(round(float(v), 9) + 0.0)
                return str(v)
            out[c] = s.map(text)
    return pd.DataFrame(out, dtype=str).sort_values(sorted(out)).reset_index(drop=True)


def same(spark_df, expected: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    got = spark_df.toPandas()
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} vs {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"rows {len(got)} vs {len(expected)}"
    a, b = _plain(got), _plain(expected)
    if a.equals(b):
        return None
    diff = (a != b).any(axis=1)
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    return (f"{int(diff.sum())} rows differ in {bad}\n{a[diff].head(3).to_string()}\n"
            f"{b[diff].head(3).to_string()}")


def types(spark_df, con, sql) -> str:
    d = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    names = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
             "boolean": "BOOLEAN", "date": "DATE"}
    return ", ".join(f"{n}:{t}/{d.get(n)}" for n, t in sorted(spark_df.dtypes)
                     if names.get(t) != d.get(n))


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tripweave.session import build_session
    sf, names = sys.argv[1], sys.argv[2:]
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, os_ = database(sf), queries(), oracle_sql()
    bad = 0
    for n in names or qs:
        t0 = time.time()
        try:
            df = qs[n](spark, sf)
            if n not in os_:
                print(f"rows  {n} {df.count()} {time.time() - t0:.1f}s", flush=True)
                continue
            t1 = time.time()
            want = con.execute(os_[n]).df()
            t2 = time.time()
            msg = same(df, want)
            t3 = time.time()
            ty = types(df, con, os_[n])
            print(f"{'ok   ' if not msg else 'FAIL '} {n} rows={len(want)} "
                  f"spark={t1 - t0 + t3 - t2:.1f}s sql={t2 - t1:.1f}s"
                  + (f" TYPES {ty}" if ty else "") + (f" {msg}" if msg else ""), flush=True)
            bad += bool(msg)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {n}: {str(e)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
