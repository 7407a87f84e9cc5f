"""Run every registered query on Spark and its SQL on DuckDB and compare all rows.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

from checks.oracle import oracle_sql
from checks.queries import queries
from reviewgraph.session import local_session

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def duck(folder: str):
    con = duckdb.connect()
    for name in TEST_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder: str, names=()) -> list[str]:
    bad, sql = [], oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        df = query(spark, folder)
        got = _rows([tuple(r) for r in df.collect()], df.columns)
        took = time.time() - start
        if name not in sql:
            print(f"--  {name}: {len(got[1])} rows, {took:.1f} s, no SQL", flush=True)
            continue
        result = con.execute(sql[name])
        columns = [d[0] for d in result.description]
        want = _rows(result.fetchall(), columns)
        ok = got == want and len(got[1]) > 0
        print(f"{'ok ' if ok else 'BAD'} {name}: {len(got[1])} rows, {took:.1f} s", flush=True)
        if not ok:
            bad.append(name)
            in_got, in_want = set(got[1]), set(want[1])
            extra = [r for r in got[1] if r not in in_want][:3]
            lack = [r for r in want[1] if r not in in_got][:3]
            print("   columns", got[0], want[0], "\n   spark only", extra, "\n   sql only", lack,
                  len(want[1]), flush=True)
    return bad


if __name__ == "__main__":
    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    failed = compare(local_session("compare"), duck(where), where, sys.argv[2:])
    print("differing:", failed or "none")
    sys.exit(bool(failed))
