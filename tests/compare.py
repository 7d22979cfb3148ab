"""Compares a Spark result with DuckDB's rows, columns by name, rows in any order."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    """A DuckDB connection with a view for each table of a folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value: object) -> object:
    return round(value, 9) if isinstance(value, float) else tuple(map(_plain, value)) if isinstance(value, list) else value


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list, list]:
    """(rows of DuckDB, rows only in Spark, rows only in DuckDB)."""
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(names)
    a = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    b = Counter(tuple(_plain(r[i]) for i in at) for r in want.fetchall())
    return sum(b.values()), list((a - b).elements()), list((b - a).elements())
