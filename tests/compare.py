"""Rows of a Spark query against those of its SQL."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con.execute(sql).df()


def _plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return f"{float(x):.9g}" if x else "0"
    return str(int(x)) if isinstance(x, (int, np.integer)) else str(x)


def rows(df) -> list[tuple]:
    return sorted(tuple(map(_plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
