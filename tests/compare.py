"""Run registered queries in Spark and DuckDB and compare whole results.

Usage: python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_datetime64_any_dtype(out[c]):
            out[c] = out[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(out[c]):
            out[c] = out[c].astype(str)
        elif pd.api.types.is_numeric_dtype(out[c]):
            out[c] = out[c].astype(float).map(lambda x: "null" if pd.isna(x) else repr(x + 0.0))
        else:
            out[c] = out[c].map(lambda x: "null" if x is None or x is pd.NaT or (isinstance(x, float) and pd.isna(x)) else str(x))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def difference(a: pd.DataFrame, b: pd.DataFrame) -> str:
    """Empty when the two results hold the same rows."""
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    ca, cb = canonical(a), canonical(b)
    if ca.equals(cb):
        return ""
    for c in ca.columns:
        bad = ca[c] != cb[c]
        if bad.any():
            i = bad.idxmax()
            return f"{int(bad.sum())} cells of {c}, e.g. spark {ca.loc[i].tolist()} sql {cb.loc[i].tolist()}"
    return "unequal"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from forelake.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g", spark__sql__execution__arrow__pyspark__enabled="true")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    sql = oracle_sql()
    names = sys.argv[2:] or list(queries())
    failed = 0
    for name in names:
        started = time.time()
        try:
            got = queries()[name](spark, sf_dir).toPandas()
            spent = time.time() - started
            verdict = "rows only" if name not in sql else (difference(got, con.execute(sql[name]).df()) or "ok")
        except Exception as e:  # noqa: BLE001
            got, spent, verdict = [], time.time() - started, f"ERROR {str(e)[:1500].replace(chr(10), ' ')[:700]}"
        failed += verdict not in ("ok", "rows only")
        print(f"{name:28s} {len(got):7d} rows {spent:6.2f}s  {verdict}", flush=True)
    print(f"{len(names)} queries, {failed} differ")


if __name__ == "__main__":
    main()
