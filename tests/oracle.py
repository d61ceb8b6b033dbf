"""Compare registered queries with their check SQL on the given tables."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def normalised(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(spark, connection, query, folder: str) -> tuple[int, list[str]]:
    """Rows and differences (empty when the results are the same)."""
    df = query.run(spark, folder)
    got = normalised(df.columns, df.collect())
    if query.sql is None:
        return len(got), []
    cursor = connection.execute(query.sql)
    columns = [d[0] for d in cursor.description]
    types = [str(d[1]) for d in cursor.description]
    want = normalised(columns, cursor.fetchall())
    problems = []
    if sorted(columns) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} / {sorted(columns)}")
    if len(got) != len(want):
        problems.append(f"{len(got)} rows / {len(want)}")
    if got != want:
        pairs = [(g, w) for g, w in zip(got, want) if g != w][:3]
        problems.append(f"values differ: {pairs}")
    spark_types = dict(df.dtypes)
    for c, t in zip(columns, types):
        s = spark_types.get(c, "?")
        expected = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
                    "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float", "HUGEINT": "-"}.get(t)
        if expected and expected != s:
            problems.append(f"type of {c}: {s} / {t}")
    return len(got), problems
