"""Compare every registered query with its oracle SQL.

    python tests/check_oracles.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def normal(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return ("f", repr(value))
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, int):
        return ("i", str(value))
    return ("s", str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, connection, sf_dir, query, oracle):
    df = query(spark, sf_dir)
    start = time.time()
    ours = rows_of(df.columns, df.collect())
    print(f"  collect {time.time() - start:.1f}s", end=" ")
    start = time.time()
    result = connection.execute(oracle)
    columns = [c[0] for c in result.description]
    theirs = rows_of(columns, result.fetchall())
    print(f"oracle {time.time() - start:.1f}s", end=" ")
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows vs {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if different:
        return f"{len(different)} of {len(ours)} rows differ, e.g.\n  {str(different[0][0])[:300]}\n  {str(different[0][1])[:300]}"
    return None


def connect(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


def main():
    import __spark_entry__ as entry
    from ranklake.session import spark_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = spark_session(
        "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for key in sys.argv[2:] or queries:
        start = time.time()
        try:
            problem = (
                compare(spark, connection, sf_dir, queries[key], oracles[key])
                if key in oracles
                else f"no oracle, {queries[key](spark, sf_dir).count()} rows"
            )
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {key} {time.time() - start:.1f}s", problem or "", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
