"""Run registered queries next to their SQL: python tests/check_queries.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from __spark_entry__ import oracle_sql, queries
from panelreg.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"memory_limit": "4GB", "threads": 4})
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.astype(object).itertuples(index=False):
        rows.append(tuple(None if pd.isna(v) else float(v) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) else v for v in row))
    return sorted(rows, key=repr)


def compare(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    ours, theirs = canonical(spark_frame), canonical(sql_frame)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else "ok"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session("local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__sql__shuffle__partitions="8")
    spark.sparkContext.setLogLevel("ERROR")
    sql = oracle_sql()
    bad = 0
    for name, run in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            ours = run(spark, sf_dir).toPandas()
            took = time.time() - start
            verdict = compare(ours, duck(sf_dir).execute(sql[name]).df()) if name in sql else f"no SQL, {len(ours)} rows"
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            took, verdict = time.time() - start, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not verdict.startswith(("ok", "no SQL"))
        print(f"{name:24s} {took:6.1f}s  {verdict}", flush=True)
    print(f"{bad} problem(s)")


if __name__ == "__main__":
    main()
