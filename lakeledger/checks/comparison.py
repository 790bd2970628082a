"""Compare registered queries with their SQL: ``python -m lakeledger.checks.comparison [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import DataFrame

from ..session import local_session
from .oracle import oracle_sql
from .queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return type(a) is type(b) and a == b


def database(directory: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{directory}/{table}.parquet'")
    return db


def difference(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, str]:
    """Number of rows and what differs: columns, row count or values, in any row order."""
    columns = sorted(df.columns)
    rows = [tuple(row) for row in df.select(*[f"`{name}`" for name in columns]).collect()]
    wanted = sorted(column[0] for column in db.execute(f"describe {sql}").fetchall())
    if columns != wanted:
        return len(rows), f"columns {columns} vs {wanted}"
    quoted = ", ".join(f'"{name}"' for name in columns)
    expected = db.execute(f"select {quoted} from ({sql})").fetchall()
    if len(rows) != len(expected):
        return len(rows), f"rows {len(rows)} vs {len(expected)}"
    pairs = zip(sorted(rows, key=_key), sorted(expected, key=_key))
    bad = [(row, other) for row, other in pairs if not all(map(_same, row, other))]
    return len(rows), f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""


def main(directory: str, only: list[str]) -> int:
    spark, db, sql = local_session("comparison"), database(directory), oracle_sql()
    failed = 0
    for name in only or sorted(QUERIES):
        start = time.time()
        count, problem = difference(QUERIES[name](spark, directory), db, sql[name])
        failed += bool(problem)
        print(f"{name:32s} {'FAIL ' + problem if problem else 'ok'} {count:8d} {time.time() - start:6.2f}s", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    where = arguments.pop(0) if arguments and "/" in arguments[0] else "/root/testdata/sf0.01"
    sys.exit(bool(main(where, arguments)))
