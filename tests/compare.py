"""Compares a Spark result with DuckDB's for the same tables."""

import os
from pathlib import Path

import duckdb
import pandas as pd


def duck(sql: str, folder: str):
    c = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return c.execute(sql).df()


def rows(df) -> list[tuple]:
    def plain(x):
        if pd.isna(x):
            return "null"
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__module__ == "numpy" and type(x).__name__ != "bool" else str(x)

    columns = sorted(df.columns)
    return sorted(tuple(plain(x) for x in r) for r in df[columns].astype(object).itertuples(index=False))
