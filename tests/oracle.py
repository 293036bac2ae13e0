"""Compare registered queries with their SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, run, sql):
    """(seconds, row count, difference or None)."""
    start = time.time()
    df = run(spark, sf_dir)
    got = df.collect()
    seconds = time.time() - start
    if sql is None:
        return seconds, len(got), None
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    expected_names, expected = as_rows(names, answer.fetchall())
    got_names, rows = as_rows(df.columns, got)
    if got_names != expected_names:
        return seconds, len(got), f"columns {got_names} != {expected_names}"
    if len(rows) != len(expected):
        return seconds, len(got), f"{len(rows)} rows != {len(expected)}"
    for a, b in zip(rows, expected):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return seconds, len(got), f"{str(a)[:400]}\n   != {str(b)[:400]}"
    return seconds, len(got), None


def main() -> int:
    import __spark_entry__ as entry
    from sheafline.session import build_session

    arguments = sys.argv[1:]
    sf_dir = arguments.pop(0) if arguments and "/" in arguments[0] else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    sqls = entry.oracle_sql()
    for name, run in entry.queries().items():
        if arguments and name not in arguments:
            continue
        try:
            seconds, count, difference = compare(spark, con, sf_dir, run, sqls.get(name))
        except Exception as error:  # noqa: BLE001 - one broken query must not hide the others
            seconds, count, difference = 0.0, 0, f"{type(error).__name__}: {str(error)[:700]}"
        state = "FAIL" if difference else ("ok" if name in sqls else "rows")
        failed += bool(difference)
        print(f"{state:5} {name:32} {count:8} rows {seconds:6.2f}s {difference or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())
