"""Runs a query's SQL in DuckDB and compares rows without regard to order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*' if os.path.isdir(path) else path}'")
    return con


def normal(frame):
    out = frame[sorted(frame.columns)].copy()
    for k in out:
        if out[k].dtype.kind in "fiu":
            out[k] = out[k].astype(float).round(5) + 0.0
    return sorted(map(tuple, out.astype(str).to_numpy().tolist()))
