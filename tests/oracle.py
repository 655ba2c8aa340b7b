"""Runs a registered query and its SQL over the same tables and compares all rows."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def text(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "null"
    if isinstance(x, pd.Timestamp):
        return str((x.tz_localize("UTC") if x.tzinfo is None else x.tz_convert("UTC")).value // 1000)
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, str):
        return x
    try:
        return f"{float(x) + 0.0:.6g}".replace("-0", "0") if float(x) == 0 else f"{float(x):.6g}"
    except (TypeError, ValueError):
        return str(x)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(text, r)) for r in df[names].itertuples(index=False, name=None))


def same(spark, folder, query, sql, con=None):
    a, b = rows(query(spark, folder).toPandas()), rows((con or connect(folder)).execute(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
