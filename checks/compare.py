"""Run queries in Spark and DuckDB on one table folder and compare all rows.

    python -m checks.compare [folder] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

from checks import entries, sql
from slotwise.session import build_session


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in data), key=repr)


def compare(spark, con, folder: str, name: str, query, statement: str | None) -> str:
    start = time.time()
    df = query(spark, folder)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if statement is None:
        return f"rows only  {name}: {len(got)} rows, {took:.1f}s"
    cur = con.execute(statement)
    columns = [d[0] for d in cur.description]
    want = rows(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS    {name}: {sorted(df.columns)} / {sorted(columns)}"
    if got == want:
        return f"equal      {name}: {len(got)} rows, {took:.1f}s"
    off = [(a, b) for a, b in zip(got, want) if a != b][:2]
    return f"DIFFERENT  {name}: {len(got)} / {len(want)} rows; {sorted(columns)} {off}"


def main(folder: str, wanted: list[str]) -> int:
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = tables(folder)
    statements = sql.build()
    bad = 0
    for name, query in entries.build().items():
        if wanted and name not in wanted:
            continue
        try:
            line = compare(spark, con, folder, name, query, statements.get(name))
        except Exception as error:  # report and go on with the next query
            line = f"FAILED     {name}: {str(error)[:600]}"
        bad += line.startswith(("COLUMNS", "DIFFERENT", "FAILED"))
        print(line, flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]) > 0)
