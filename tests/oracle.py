"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype("int64")
        if pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].astype("string")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, expected: pd.DataFrame) -> str:
    """Empty if the tables hold the same rows."""
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} and {sorted(expected.columns)}"
    a, b = _plain(got), _plain(expected)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    try:
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=2e-6)
    except AssertionError as e:
        return str(e)[:600]
    return ""
