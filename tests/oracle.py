"""Compare query results with what DuckDB computes from the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return connection


def _normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    normal = [tuple(_normal(row[i]) for i in order) for row in rows]
    return sorted(normal, key=lambda r: tuple((v is not None, str(v)) for v in r))


def differences(result, connection, sql: str) -> list[str]:
    """Human-readable differences between a Spark result and a query; empty when they agree."""
    answer = connection.execute(sql)
    expected_columns = [d[0] for d in answer.description]
    expected = answer.fetchall()
    found = [tuple(r) for r in result.collect()]
    if sorted(result.columns) != sorted(expected_columns):
        return [f"columns {sorted(result.columns)} instead of {sorted(expected_columns)}"]
    ours, theirs = _rows(result.columns, found), _rows(expected_columns, expected)
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows instead of {len(theirs)}"]
    names = sorted(expected_columns)
    out = []
    for a, b in zip(ours, theirs):
        for name, x, y in zip(names, a, b):
            if x != y or isinstance(x, bool) != isinstance(y, bool):
                out.append(f"{name}: {x!r} instead of {y!r} in {a}")
    return out
