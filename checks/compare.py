"""Runs queries and their SQL counterparts on one data folder and compares the rows.

    python -m checks.compare /root/testdata/sf0.001 [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracles import ORACLES
from checks.queries import QUERIES
from checks.views import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _key(value) -> str:
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_key(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = QUERIES[name](spark, sf_dir)
    ours = rows_of(df.columns, df.collect())
    seconds = time.time() - started
    if name not in ORACLES:
        return len(ours) > 0, f"{len(ours)} rows, {seconds:.1f} s, no SQL"
    started = time.time()
    result = connection.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    note = f"{len(ours)} rows, {seconds:.1f} s, SQL {time.time() - started:.1f} s"
    if sorted(columns) != sorted(df.columns):
        return False, f"{note}: columns {sorted(df.columns)} against {sorted(columns)}"
    if ours != theirs:
        missing = sorted(set(theirs) - set(ours))[:2]
        extra = sorted(set(ours) - set(theirs))[:2]
        return False, f"{note}, SQL {len(theirs)} rows; missing {missing}; extra {extra}"
    return True, note


def main() -> None:
    from checks.session import session

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, connection = session(), duck(sf_dir)
    for name in names:
        try:
            good, note = compare(spark, connection, sf_dir, name)
        except Exception as failure:
            good, note = False, f"{type(failure).__name__}: {str(failure)[:1500]}"
        print("ok  " if good else "FAIL", name, note, flush=True)


if __name__ == "__main__":
    main()
