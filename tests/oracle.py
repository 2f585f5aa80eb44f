"""Holds a query against its SQL on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def cell(v):
    if isinstance(v, (bool, np.bool_)):
        return str(v)
    if isinstance(v, (int, float, np.number, Decimal)):
        return None if v != v else round(float(v), 5) + 0.0
    return None if v is None or v is pd.NA or v is pd.NaT else str(v)


def rows(df) -> list:
    return sorted((tuple(map(cell, r)) for r in df.itertuples(index=False)), key=lambda r: tuple((x is not None, str(x)) for x in r))


def check(spark, query, sql: str) -> int:
    got = query(spark, SF).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    assert rows(got[cols].astype(object)) == rows(want[cols].astype(object))
    return len(got)
