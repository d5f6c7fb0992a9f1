"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str:
    """Empty if equal, else what differs."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but SQL has {sorted(names)}"
    if got == want:
        return ""
    only_got, only_want = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} rows, SQL {len(want)}; only here {sorted(only_got)[:3]}; only SQL {sorted(only_want)[:3]}"


def main() -> None:
    """``python tests/compare.py FOLDER [NAME…]``"""
    import __spark_entry__ as contract
    from tidemark.session import build_session

    folder, *wanted = sys.argv[1:]
    spark = build_session("compare", "local[8]", 8, spark_ui_enabled="false", spark_driver_memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(folder), contract.oracle_sql()
    for name, build in contract.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            found = differences(df, con, sql[name]) if name in sql else f"no SQL, {df.count()} rows"
        except Exception as error:  # noqa: BLE001
            found = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28s} {time.time() - start:6.2f}s  {found or 'ok'}", flush=True)


if __name__ == "__main__":
    main()
