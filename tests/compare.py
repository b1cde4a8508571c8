"""Rows of a DataFrame against rows of SQL on the same tables."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, d: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c.execute(sql).df()


def plain(df):
    def value(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x is pd.NA or x != x:
            return "null"
        if isinstance(x, float):
            return repr(int(x)) if x == int(x) else repr(round(x, 9))
        return repr(x)

    cols = sorted(df.columns)
    return cols, sorted(tuple(map(value, r)) for r in df[cols].itertuples(index=False, name=None))
