"""Run registered queries next to their SQL: ``python -m tests.compare [sf] [name...]``."""

from __future__ import annotations

import datetime
import sys
import time
import traceback

import duckdb

import __spark_entry__ as driver
from loadlens.sources.tables import DRIVER_TABLES

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def oracle(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(_plain(r[i])) for i in order) for r in rows))


def differences(spark, con, folder: str, name: str) -> list[str]:
    """Empty when Spark and the SQL give the same columns, types and rows."""
    df = driver.queries()[name](spark, folder)
    mine = _rows(df.columns, df.collect())
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return [] if mine else ["no rows"]
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    theirs_types = dict(zip(theirs_names, (str(d[1]) for d in result.description)))
    theirs = _rows(theirs_names, result.fetchall())
    found = []
    if sorted(df.columns) != sorted(theirs_names):
        found.append(f"columns {sorted(df.columns)} != {sorted(theirs_names)}")
    for column, kind in df.dtypes:
        if KINDS.get(kind, kind) != theirs_types.get(column):
            found.append(f"type of {column}: {kind} != {theirs_types.get(column)}")
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows != {len(theirs)}")
    unlike = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if unlike:
        found.append(f"{len(unlike)} rows differ, e.g. {unlike[0]}")
    return found


def main() -> int:
    from tests.conftest import make_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    names = sys.argv[2:] or list(driver.queries())
    spark, con, bad = make_session(), oracle(folder), 0
    for name in names:
        begin = time.time()
        try:
            found = differences(spark, con, folder, name)
        except Exception:
            found = [traceback.format_exc()[-1500:]]
        bad += bool(found)
        print(f"{name:28s} {time.time() - begin:6.2f}s {'ok' if not found else found}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
