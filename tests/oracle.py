"""Run a query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str = DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    out = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("null" if v is None or v is pd.NaT or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v) for v in row))
    return sorted(out)


def kinds(frame: pd.DataFrame) -> dict:
    return {c: frame[c].dtype.kind for c in sorted(frame.columns)}


def differences(spark, query, sql: str, folder: str = DATA, con=None) -> list[str]:
    con = con or connect(folder)
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    out = []
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} {sorted(want.columns)}"]
    if len(got) != len(want):
        out.append(f"rows {len(got)} {len(want)}")
    a, b = rows(got), rows(want)
    if a != b:
        out.append(f"values: only here {sorted(set(a) - set(b))[:3]}, only in SQL {sorted(set(b) - set(a))[:3]}")
    if kinds(got) != kinds(want):
        out.append(f"types {[(c, kinds(got)[c], kinds(want)[c]) for c in kinds(got) if kinds(got)[c] != kinds(want)[c]]}")
    return out
