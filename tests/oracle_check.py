"""Compares registered queries with their DuckDB counterparts."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str | None:
    """None when both sides agree in columns and rows, else a short account."""
    expected = con.sql(sql)
    if sorted(df.columns) != sorted(expected.columns):
        return f"columns {sorted(df.columns)} != {sorted(expected.columns)}"
    kinds = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR",
             "timestamp": "TIMESTAMP", "boolean": "BOOLEAN"}
    theirs = dict(zip(expected.columns, map(str, expected.types)))
    odd = [(c, t, theirs[c]) for c, t in df.dtypes if kinds.get(t) != theirs[c]]
    mine, want = rows_of(df.columns, df.collect()), rows_of(expected.columns, expected.fetchall())
    if mine == want:
        return f"types {odd}" if odd else None
    extra, missing = [r for r in mine if r not in set(want)], [r for r in want if r not in set(mine)]
    return f"rows {len(mine)} vs {len(want)}; extra {extra[:2]}; missing {missing[:2]}; types {odd}"
