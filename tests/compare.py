"""Running a query and its SQL side by side."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str | None]:
    """Number of rows and, if the two differ, in what."""
    relation = con.sql(sql)
    if sorted(df.columns) != sorted(relation.columns):
        return 0, f"columns {sorted(df.columns)} against {sorted(relation.columns)}"
    got = rows_of(df.columns, df.collect())
    expected = rows_of(relation.columns, relation.fetchall())
    if got != expected:
        extra, missing = list((got - expected).items())[:2], list((expected - got).items())[:2]
        return sum(got.values()), f"{sum(expected.values())} expected; extra {extra}; missing {missing}"
    return sum(got.values()), None
