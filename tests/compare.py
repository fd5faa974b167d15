"""Side-by-side run of check queries on Spark and their SQL on DuckDB.

Usage: ``python -m tests.compare [sf_dir] [query ...]``
"""

from __future__ import annotations

import math
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(df, connection, sql: str) -> str | None:
    """Text of the difference, or None when columns, kinds of types and rows agree."""
    cursor = connection.execute(sql)
    wanted_columns = [d[0] for d in cursor.description]
    wanted = _rows(wanted_columns, cursor.fetchall())
    if sorted(df.columns) != sorted(wanted_columns):
        return f"columns {sorted(df.columns)} != {sorted(wanted_columns)}"
    kinds = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = dict(zip(wanted_columns, [str(d[1]) for d in cursor.description]))
    wrong = [(n, t, types[n]) for n, t in df.dtypes if kinds.get(t, t) != types[n]]
    got = _rows(df.columns, df.collect())
    if got != wanted:
        missing, extra = list((wanted - got).items())[:3], list((got - wanted).items())[:3]
        return f"{sum(got.values())} rows, wanted {sum(wanted.values())}\n  missing {missing}\n  extra   {extra}"
    return f"types {wrong}" if wrong else None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from fleetlens.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duck(sf_dir)
    sql, failed = oracle_sql(), 0
    for name, query in queries().items():
        if argv[1:] and not any(name.startswith(wanted) for wanted in argv[1:]):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            problem = compare(df, connection, sql[name]) if name in sql else (None if df.count() else "no rows")
        except Exception:
            problem = traceback.format_exc(limit=3)[-1800:]
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
