"""Run registered queries next to their SQL: ``python -m tests.compare [sf] [prefix ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# Spark type names and what the other side calls them.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _table(columns, rows):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    cells = [tuple(str(_cell(r[i])) for i in at) for r in rows]
    return order, sorted(cells)


def compare(spark, con, folder: str, fn, sql: str) -> str | None:
    """None when both agree, else what differs."""
    df = fn(spark, folder)
    columns, ours = _table(df.columns, [tuple(r) for r in df.collect()])
    relation = con.sql(sql)
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    other_columns, theirs = _table(relation.columns, relation.fetchall())
    if columns != other_columns:
        return f"columns {columns} against {other_columns}"
    wrong = {c: (k, kinds[c]) for c, k in df.dtypes if TYPES.get(k, k) != kinds[c]}
    if wrong:
        return f"types {wrong}"
    if ours != theirs:
        first = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
        return f"{len(ours)} rows against {len(theirs)}; {columns}; {str(first)[:1500]}"
    if not ours:
        return "both empty"
    return None


def main(sf: str = "0.001", *prefixes: str) -> int:
    from reportloom.plans import REGISTRY
    from reportloom.session import local_session

    folder = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(), connect(folder), 0
    for name, (fn, sql) in REGISTRY.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            if sql is None:
                problem = f"rows only: {fn(spark, folder).count()}"
            else:
                problem = compare(spark, con, folder, fn, sql)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None and not problem.startswith("rows only")
        print(f"{name} {problem or 'ok'} {time.time() - start:.2f}s", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
