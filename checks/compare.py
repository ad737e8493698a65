"""Run registered queries next to their SQL in DuckDB and compare rows.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from checks import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "-"
    return repr(value.item() if hasattr(value, "item") else value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir, name, run, sql):
    """(ok, message) for one query."""
    start = time.time()
    frame = run(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    spent = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {spent:.1f}s"
    start = time.time()
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    note = f"{len(got)} rows, {spent:.1f}s, sql {time.time() - start:.1f}s"
    if sorted(columns) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} against {sorted(columns)}"
    a, b = rows_of(frame.columns, got), rows_of(columns, want)
    if a == b:
        return bool(a), note + ("" if a else " EMPTY")
    odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"{note}; {len(a)} against {len(b)} rows; first differences {odd}"


def main():
    from bench import session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark, con = session(), connect(sf_dir)
    sqls, bad = oracle_sql(), []
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        try:
            ok, message = compare(spark, con, sf_dir, name, run, sqls.get(name))
        except Exception as error:  # report and go on
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(("ok   " if ok else "FAIL ") + name, message, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
