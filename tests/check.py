"""Run registered queries against DuckDB: ``python tests/check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float)
    df = df.astype(object).where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.map(repr)).reset_index(drop=True)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    for c in spark_df.columns:  # nullable integers: floats on one side, masked integers on the other
        if spark_df[c].isna().any() and spark_df[c].dtype.kind == "f" and sql_df[c].dtype.kind == "i":
            sql_df[c] = sql_df[c].astype(float)
    kinds = {c: (spark_df[c].dtype.kind, sql_df[c].dtype.kind) for c in spark_df.columns}
    odd = {c: k for c, k in kinds.items() if k[0] != k[1] and spark_df[c].notna().any()}
    if odd:
        return f"types differ: {odd}"
    a, b = canonical(spark_df), canonical(sql_df)
    bad = ~(a.map(repr) == b.map(repr)).all(axis=1)
    if bad.any():
        i = bad[bad].index[0]
        return f"{int(bad.sum())} rows differ, first:\n  spark {a.loc[i].to_dict()}\n  duck  {b.loc[i].to_dict()}"
    return None


def main() -> int:
    from gridloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session(master="local[8]", shuffle_partitions=8, quiet=True)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf), []
    for name in names:
        start = time.time()
        try:
            got = entry.queries()[name](spark, sf).toPandas()
            took = time.time() - start
            sql = entry.oracle_sql().get(name)
            problem = difference(got, con.execute(sql).df()) if sql else (None if len(got) else "no rows")
        except Exception as e:  # noqa: BLE001
            took, got, sql, problem = time.time() - start, [], "", f"{type(e).__name__}: {str(e)[:1500]}"
        finally:
            spark.catalog.clearCache()
        print(f"{'FAIL' if problem else 'ok  '} {name:24s} {took:6.2f}s rows={len(got)} {'sql' if sql else 'rows only'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
