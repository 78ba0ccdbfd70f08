"""Rows of a query and of its SQL, in one form."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

SF_DIR = "/root/testdata/sf0.01"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value.isoformat() if hasattr(value, "isoformat") else value


def canonical(columns, rows):
    """Column names in order, and rows sorted with their values in that order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def of_spark(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def of_sql(sql, sf_dir=SF_DIR, tables=None):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    for name, table in (tables or {}).items():
        con.register(f"_{name}", table)
        con.execute(f"create or replace view {name} as select * from _{name}")
    found = con.execute(sql)
    return canonical([d[0] for d in found.description], found.fetchall())
