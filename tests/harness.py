"""Run a registered query and its SQL over the same parquet files and compare them."""

from __future__ import annotations

import os
import sys
import threading
import time

import duckdb
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def kind(t: pa.DataType) -> str:
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    return str(t)


def rows_of(table: pa.Table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(zip(*columns), key=repr) if columns else []
    return names, [kind(table.schema.field(n).type) for n in names], rows


def difference(spark_table: pa.Table, sql_table: pa.Table) -> str | None:
    names, kinds, rows = rows_of(spark_table)
    sql_names, sql_kinds, sql_rows = rows_of(sql_table)
    if names != sql_names:
        return f"columns {names} against {sql_names}"
    if kinds != sql_kinds:
        return "types " + str([(n, a, b) for n, a, b in zip(names, kinds, sql_kinds) if a != b])
    if len(rows) != len(sql_rows):
        return f"{len(rows)} rows against {len(sql_rows)}"
    off = [(a, b) for a, b in zip(rows, sql_rows) if repr(a) != repr(b)]
    return f"{len(off)} of {len(rows)} rows differ, first {str(off[0])[:600]}" if off else None


def check(spark, folder: str, name: str, con) -> tuple[str | None, float, int]:
    from promptmill.queries import ORACLES, QUERIES
    start = time.time()
    result = QUERIES[name](spark, folder).toArrow()
    seconds = time.time() - start
    if name not in ORACLES:
        return None, seconds, result.num_rows
    stop = threading.Timer(60, con.interrupt)
    stop.start()
    try:
        expected = con.execute(ORACLES[name]).to_arrow_table()
    finally:
        stop.cancel()
    return difference(result, expected), seconds, result.num_rows


def main() -> None:
    from promptmill.queries import ORACLES, QUERIES
    from promptmill.session import build_session
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", 8, spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    wanted = sys.argv[1:] or list(QUERIES)
    bad = 0
    for name in [n for n in QUERIES if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]:
        try:
            problem, seconds, rows = check(spark, folder, name, con)
        except Exception as error:  # report and go on with the next query
            problem, seconds, rows = f"{type(error).__name__}: {str(error)[:700]}", 0.0, 0
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in ORACLES else "rows")
        print(f"{mark} {name} {rows} rows {seconds:.2f}s {problem or ''}", flush=True)
    print(f"{bad} failures")


if __name__ == "__main__":
    main()
