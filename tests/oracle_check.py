"""Compare registered queries with their SQL: ``python tests/oracle_check.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def normal(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str, query, sql: str | None) -> str:
    """Empty when equal, else what differs."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return "" if got else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    kinds = [str(d[1]) for d in cursor.description]
    names = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = {c: names.get(t, t) for c, t in df.dtypes}
    if types != dict(zip(columns, kinds)):
        return f"types {types} != {dict(zip(columns, kinds))}"
    a, b = normal(df.columns, got), normal(columns, want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"rows {len(a)} / {len(b)} spark-only {str(only_a)[:400]} sql-only {str(only_b)[:400]} {df.dtypes} {kinds}"
    return "" if got else "equal but empty"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from cohortlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(cpus=8), connect(sf_dir)
    sqls = oracle_sql()
    for name, query in queries().items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            outcome = compare(spark, con, sf_dir, name, query, sqls.get(name)) or "ok"
        except Exception as e:  # noqa: BLE001 - report and go on
            outcome = f"ERROR {str(e)[:700]}"
        print(f"## {name:22s} {time.time() - t0:6.1f}s {'sql ' if name in sqls else 'rows'} {outcome}", flush=True)


if __name__ == "__main__":
    main()
