"""Runs a query and its SQL twin on the same tables."""

import glob
import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(df: pd.DataFrame, cols: list) -> list:
    clean = [[None if v is None or v is pd.NA or v != v else v for v in r] for r in df[cols].astype(object).itertuples(index=False, name=None)]
    return sorted(repr([v.item() if hasattr(v, "item") else v for v in r]) for r in clean)


def same(got: pd.DataFrame, sql: str, sf_dir: str = SF) -> None:
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    want = c.sql(sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert rows(got, cols) == rows(want, cols)
