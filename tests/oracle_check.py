"""Compare queries with their SQL on the same tables: ``python tests/oracle_check.py <folder> [names]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return int(value)
    if isinstance(value, float):
        return float(f"{value:.12g}")
    if type(value).__name__ == "Decimal":
        return normal(float(value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, name, query, sql, folder):
    """Return None when equal, else what differs."""
    df = query(spark, folder)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} <> {want_columns}"
    if len(got) != len(want):
        a, b = set(got), set(want)
        return f"rows {len(got)} <> {len(want)}; only ours {list(a - b)[:2]}; only SQL {list(b - a)[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sum(x != y for x, y in zip(got, want))} rows differ, first: {a} <> {b}"
    return None


def main():
    import __spark_entry__ as contract
    from trackloom.session import build_session

    QUERIES, ORACLES = contract.queries(), contract.oracle_sql()
    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("oracle check", "local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(folder), []
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, name, QUERIES[name], ORACLES[name], folder)
            else:
                problem = f"no SQL, {QUERIES[name](spark, folder).count()} rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {'ok' if problem is None else problem} ({time.time() - start:.1f} s)", flush=True)
        if problem and not problem.startswith("no SQL"):
            failed.append(name)
    print("FAILED:", failed)


if __name__ == "__main__":
    main()
