"""Compare a query's rows with DuckDB's, as sorted columns and counted rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    return con


def value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(value(y) for y in x)
    return x if isinstance(x, (int, str)) else str(x)


def counted(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(value(r[i]) for i in order) for r in rows)


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    return sorted(df.columns), counted(df.columns, df.collect())


def sql_rows(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return sorted(names), counted(names, got.fetchall())
