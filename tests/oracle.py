"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.sql(f"CREATE VIEW {name} AS FROM '{path}'")
    return connection


def _value(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6f}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_value(row[i]) for i in order) for row in rows)


def difference(spark, connection, name, query, sql, sf_dir) -> str | None:
    """None if both give the same table, else what differs."""
    frame = query(spark, sf_dir)
    if "CartesianProduct" in frame._jdf.queryExecution().toString():
        return f"{name}: compares all pairs"
    got = table(frame.columns, [tuple(row) for row in frame.collect()])
    answer = connection.sql(sql)
    want = table(answer.columns, answer.fetchall())
    if sorted(frame.columns) != sorted(answer.columns):
        return f"{name}: columns {sorted(frame.columns)} against {sorted(answer.columns)}"
    if got != want:
        more = [row for row in got if row not in set(want)][:2]
        less = [row for row in want if row not in set(got)][:2]
        return f"{name}: {len(got)} rows against {len(want)}; only here {more}, only there {less}"
    return None
