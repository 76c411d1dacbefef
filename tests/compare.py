"""Rows as the driver compares them: columns by name, order of rows left out."""

import duckdb
import pandas as pd

TABLES = "documents pages embeddings labels benchmark conversations events".split()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v.item() if hasattr(v, "item") else v


def rows(frame: pd.DataFrame):
    names = sorted(frame.columns)
    return names, sorted((tuple(plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False, name=None)), key=repr)


def database(sf: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c
