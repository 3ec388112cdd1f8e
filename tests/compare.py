"""Run registered queries against DuckDB: `python -m tests.compare [sf] [name-prefix…]`."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples, columns by name; numbers compare by value."""

    def cell(v):
        if v is None or (isinstance(v, float) and pd.isna(v)) or v is pd.NaT or v is pd.NA:
            return "∅"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10] if v.isoformat().endswith("T00:00:00") else v.isoformat()
        if isinstance(v, str):
            return v
        return repr(float(v))

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False, name=None))


def compare(spark, con, name: str, job, sql: str | None, folder: str) -> tuple[bool, str]:
    started = time.time()
    got = job(spark, folder).toPandas()
    took = time.time() - started
    if sql is None:
        return len(got) > 0, f"{name}: {len(got)} rows, {took:.1f}s (no SQL)"
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"{name}: columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a == b:
        return True, f"{name}: {len(a)} rows, {took:.1f}s"
    only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return False, f"{name}: {len(a)} vs {len(b)} rows; {sorted(got.columns)}\n  spark {only[0]}\n  sql   {only[1]}"


def main() -> None:
    from retailscope.plans.catalog import CHECKS, QUERIES
    from retailscope.session import local_session

    scale, prefixes = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    folder = f"/root/testdata/sf{scale}"
    spark, con = local_session(cores=8), connect(folder)
    bad = 0
    for name, job in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, text = compare(spark, con, name, job, CHECKS.get(name), folder)
        except Exception as error:  # report and go on
            ok, text = False, f"{name}: {type(error).__name__} {str(error)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", text, flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
