"""Compares a query with its SQL twin on DuckDB: names, row counts and values, whatever the order of rows."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, Decimal):
        return str(x.normalize())
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    return x


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of_sql(con, sql: str):
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(repr([plain(r[k]) for k in order]) for r in out.fetchall())


def rows_of_frame(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
