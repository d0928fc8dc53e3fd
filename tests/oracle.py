"""Comparison of a query's rows with its SQL's rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)

    def cell(x):
        if x is None or x is pd.NaT:
            return "None"
        return repr(round(float(x), 9)) if isinstance(x, float) else str(x)

    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False)), sorted(df.columns)
