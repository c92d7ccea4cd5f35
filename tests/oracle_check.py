"""Run registered queries against their SQL: python tests/oracle_check.py SF_DIR [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def spark_result(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def sql_result(con, sql):
    cursor = con.execute(sql)
    return normal([d[0] for d in cursor.description], cursor.fetchall())


def difference(ours, theirs) -> str | None:
    """None if equal, by value and by type, else a short account."""
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} / {b}"[:600]
    return None


if __name__ == "__main__":
    from passageway.session import local_session

    import __spark_entry__ as entry

    spark, con = local_session(), connect(sys.argv[1])
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            start = time.time()
            ours = spark_result(query(spark, sys.argv[1]))
            took = time.time() - start
            start = time.time()
            state = "no SQL" if name not in sqls else difference(ours, sql_result(con, sqls[name])) or "same"
            print(f"{name}: {len(ours[1])} rows, {took:.2f}s / {time.time() - start:.2f}s, {state}", flush=True)
        except Exception as e:
            print(f"{name}: FAILED {type(e).__name__} {str(e)[:700]}", flush=True)
