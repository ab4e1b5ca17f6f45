"""Run registered queries next to their SQL twins: python tests/compare.py [sf_dir] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

import __spark_entry__ as entry  # noqa: E402
from tonewise.session import build_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value: object) -> str:
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return repr(value + 0.0) if value != 0 else "0.0"
    return str(value)


def rows_of(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf: str) -> tuple[str, int, float, float]:
    started = time.time()
    frame = entry.queries()[name](spark, sf)
    got = rows_of(frame.columns, frame.collect())
    spent = time.time() - started
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "rows-only", len(got[1]), spent, 0.0
    started = time.time()
    cursor = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    twin = time.time() - started
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}
    typed = all(same.get(kind, kinds.get(name)) == kinds.get(name) for name, kind in frame.dtypes)
    if got == want and typed:
        return "ok", len(got[1]), spent, twin
    detail = f"columns {got[0]} / {want[0]}; rows {len(got[1])} / {len(want[1])}; {dict(frame.dtypes)} / {kinds}"
    extra = [r for r in got[1] if r not in set(want[1])][:3]
    missing = [r for r in want[1] if r not in set(got[1])][:3]
    return f"DIFF {detail}\n   spark only {str(extra)[:900]}\n   twin only {str(missing)[:900]}", len(got[1]), spent, twin


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    bad = 0
    for name in args or list(entry.queries()):
        try:
            status, n, spent, twin = compare(spark, con, name, sf)
        except Exception as error:  # noqa: BLE001
            status, n, spent, twin = f"ERROR {str(error)[:700]}", -1, 0.0, 0.0
        bad += not status.startswith(("ok", "rows-only"))
        if not status.startswith(("ok", "rows-only")):
            spark.catalog.clearCache()
        print(f"{name:28s} {n:8d} {spent:6.2f}s {twin:6.2f}s {status}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
