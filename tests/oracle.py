"""Compare registered queries with their SQL in DuckDB.

``python -m tests.oracle [folder] [name-prefix …]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return round(float(value), 6)
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(norm(r[i]) for i in order) for r in rows), key=repr
    )


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, folder: str, name: str, fn, sql: str | None):
    start = time.time()
    df = fn(spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    cols, got = rows_of(df.columns, got_rows)
    if sql is None:
        return ("ROWS" if got else "EMPTY"), len(got), spent, ""
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != want_cols:
        return "COLUMNS", len(got), spent, f"{cols} != {want_cols}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return "DIFF", len(got), spent, (
            f"{len(got)} vs {len(want)}\n  spark: {sorted(a - b)[:2]}\n  sql:   {sorted(b - a)[:2]}"
        )
    return "ok" if got else "EMPTY", len(got), spent, ""


def main() -> None:
    from lorespark.plans.catalog import ORACLES, QUERIES
    from lorespark.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, n, spent, note = compare(spark, con, folder, name, fn, ORACLES.get(name))
        except Exception as error:
            status, n, spent, note = "ERROR", 0, 0.0, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{status:8}{name:34}{n:8d} rows {spent:7.2f}s {note[:1500]}", flush=True)


if __name__ == "__main__":
    main()
