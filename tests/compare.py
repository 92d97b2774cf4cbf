"""Comparison of a Spark result with DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TESTDATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def bag(columns, rows) -> Counter:
    """Rows as a multiset, columns in order of name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def spark_bag(df) -> Counter:
    return bag(df.columns, [tuple(row) for row in df.collect()])


def duck_bag(con, sql: str) -> Counter:
    result = con.execute(sql)
    return bag([d[0] for d in result.description], result.fetchall())


# Spark type -> DuckDB type, for the types results may have.
SAME_TYPE = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
}


def spark_types(df) -> dict[str, str]:
    return {name: SAME_TYPE[dtype] for name, dtype in df.dtypes}


def duck_types(con, sql: str) -> dict[str, str]:
    return {d[0]: str(d[1]) for d in con.execute(sql).description}
