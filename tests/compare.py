"""Compare a DataFrame with DuckDB SQL over the same Parquet tables."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).df()


def cell(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
        return "<null>"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.number, decimal.Decimal)):
        return repr(round(float(x), 9) + 0.0)
    if isinstance(x, (pd.Timestamp, datetime.datetime)):
        return pd.Timestamp(x).isoformat()
    return str(x)


def canonical(df):
    return sorted(tuple(map(cell, row)) for row in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


def assert_same(spark, df, sql, data):
    got, want = df.toPandas(), duck(sql, data)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b), (len(a), len(b))
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    assert not diff, diff[:3]
