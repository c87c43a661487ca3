"""Runs registered queries next to their SQL on DuckDB and compares values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = os.path.join(sf_dir, f"{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    plain.sort(key=lambda row: tuple((v is not None, str(type(v)), v if v is not None else 0) for v in row))
    return [columns[i] for i in order], plain


def compare(spark_df, con, sql) -> str | None:
    """None when equal, else a short description of the difference."""
    left_columns, left = normalise(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    right_columns, right = normalise([c[0] for c in cursor.description], cursor.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} vs {right_columns}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"first difference {a} vs {b}"
    return None
