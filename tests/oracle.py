"""Spark and DuckDB side by side, by sorted columns and rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0!r}"
    return "" if value is None else str(value)


def rows_of(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, folder: str, query, sql: str) -> str:
    """Empty, if both give the same columns and rows."""
    df = query(spark, folder)
    relation = views(folder).sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} and {sorted(relation.columns)}"
    own, other = rows_of(df.columns, df.collect()), rows_of(relation.columns, relation.fetchall())
    if own == other:
        return ""
    a, b = set(own) - set(other), set(other) - set(own)
    return f"{len(own)} and {len(other)} rows; only here {sorted(a)[:4]}; only there {sorted(b)[:4]}"
