"""Run a query beside its SQL in DuckDB and compare all values."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        at = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{at}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if not isinstance(v, list) and pd.isna(v) else str(v) if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v
    rows = [tuple(plain(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)
