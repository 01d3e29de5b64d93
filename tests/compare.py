"""Compare a Spark result with a DuckDB statement, ignoring row order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(repr(value)) + 0.0
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return datetime.datetime(value.year, value.month, value.day)
    return value


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(cells, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def differences(result: DataFrame, connection, sql: str) -> list[str]:
    """Human-readable mismatches, none if the results agree exactly."""
    cursor = connection.execute(sql)
    expected_names = [d[0] for d in cursor.description]
    if sorted(result.columns) != sorted(expected_names):
        return [f"columns {sorted(result.columns)} != {sorted(expected_names)}"]
    expected = _rows(expected_names, cursor.fetchall())
    actual = _rows(result.columns, result.collect())
    found = []
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows, expected {len(expected)}")
    bad = [(a, e) for a, e in zip(actual, expected) if a != e]
    found += [f"{len(bad)} rows differ, e.g. {a} != {e}" for a, e in bad[:2]]
    return found
