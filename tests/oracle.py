"""Compare registered queries with their SQL: python tests/oracle.py [sf] [query ...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidebars.plans import catalog  # noqa: E402
from tidebars.session import build_session  # noqa: E402


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if pd.api.types.is_datetime64_any_dtype(pdf[c]):
            pdf[c] = pdf[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_float_dtype(pdf[c]):
            pdf[c] = pdf[c].map(lambda v: "null" if pd.isna(v) else repr(float(v)))
        else:
            pdf[c] = pdf[c].map(lambda v: _text(v))
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


def _text(v) -> str:
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return "[" + ",".join(_text(x) for x in v) + "]"
    if isinstance(v, dict):
        return str(sorted((k, _text(x)) for k, x in v.items()))
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, float):
        return repr(float(v)) if not float(v).is_integer() else str(int(v))
    return str(v)


def compare(spark, con, folder: str, name: str) -> str:
    t = time.time()
    got = catalog.queries()[name](spark, folder)
    types = dict(got.dtypes)
    left = canonical(got.toPandas())
    took = time.time() - t
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        return f"rows-only {len(left)} rows  {took:.1f}s"
    t = time.time()
    right = canonical(con.execute(sql).df())
    sql_took = time.time() - t
    if list(left.columns) != list(right.columns):
        return f"FAIL columns {list(left.columns)} != {list(right.columns)}"
    if len(left) != len(right):
        return f"FAIL rows {len(left)} != {len(right)}"
    if len(left) == 0:
        return "FAIL empty"
    bad = (left != right).any(axis=1)
    if bad.any():
        diff = [c for c in left.columns if (left[c] != right[c]).any()]
        i = bad[bad].index[0]
        return (f"FAIL {int(bad.sum())}/{len(left)} rows differ in {diff} ({types})\n   spark {left.loc[i].to_dict()}"
                f"\n   sql   {right.loc[i].to_dict()}")
    return f"ok {len(left)} rows  spark {took:.1f}s sql {sql_took:.1f}s"


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = sys.argv[2:] or list(catalog.queries())
    spark = build_session(**{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        try:
            text = compare(spark, con, folder, name)
        except Exception as exc:  # report and go on with the next query
            text = f"FAIL {type(exc).__name__}: {str(exc)[:1500]}"
        failed += text.startswith("FAIL")
        print(f"{name:28s} {text}", flush=True)
    print(f"{len(names) - failed}/{len(names)} fine")


if __name__ == "__main__":
    main()
