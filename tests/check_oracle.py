"""Run registered queries beside their DuckDB SQL and compare whole results.

    python tests/check_oracle.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _cells(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal":
            return float(v)
        return str(v)

    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False, name=None)), key=repr)


def compare(spark_frame: pd.DataFrame, duck_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(duck_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(duck_frame.columns)}"
    left, right = _cells(spark_frame), _cells(duck_frame)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"{sorted(spark_frame.columns)}\n   spark {a}\n   duck  {b}"
    return None


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_problem(frame, con, sql: str) -> str | None:
    """Column types that differ between the two results."""
    duck = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    wrong = {n: (t, duck.get(n)) for n, t in frame.dtypes if KINDS.get(t) != duck.get(n)}
    return f"types {wrong}" if wrong else None


def main() -> int:
    from tests.conftest import session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session()
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    failed = []
    for name in wanted:
        began = time.time()
        try:
            frame = queries[name](spark, folder)
            got = frame.toPandas()
        except Exception as error:  # keep going, report at the end
            failed.append(name)
            print(f"ERROR {name}: {str(error)[:600]}", flush=True)
            continue
        spent = time.time() - began
        if name not in sql:
            print(f"rows  {name}: {len(got)} ({spent:.1f}s)", flush=True)
            continue
        began = time.time()
        try:
            problem = compare(got, con.execute(sql[name]).df()) or type_problem(frame, con, sql[name])
        except Exception as error:
            problem = f"oracle: {str(error)[:600]}"
        print(f"{'ok   ' if problem is None else 'FAIL '} {name}: {len(got)} rows (spark {spent:.1f}s, duckdb {time.time() - began:.1f}s) {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    unknown = set(sql) - set(queries)
    print("failed:", failed, "oracle without query:", sorted(unknown))
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
