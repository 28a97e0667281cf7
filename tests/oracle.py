"""Compare a query with its SQL, as sets of rows."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(df: pd.DataFrame) -> list[tuple[str, ...]]:
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple("null" if isinstance(v, float) and v != v else cell(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else cell(v) for v in r) for r in df.itertuples(index=False))
