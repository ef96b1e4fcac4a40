"""Compare every query that has SQL with DuckDB's answer: ``python tests/check_oracles.py [folder] [query...]``."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def rows_of(columns: list[str], rows: list) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 5)
        return x

    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder: str, query, sql: str) -> tuple[bool, str]:
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if sorted(df.columns) != sorted(d[0] for d in cur.description):
        return False, f"columns {df.columns} / {[d[0] for d in cur.description]}"
    if mine == theirs:
        return True, f"{len(mine)} rows"
    a, b = set(map(repr, mine)), set(map(repr, theirs))
    return False, f"{len(mine)} / {len(theirs)} rows; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"


def main(args: list[str]) -> int:
    os.environ.setdefault("PYTHONPATH", ROOT)
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    folder, names = (args[0] if args else "/root/testdata/sf0.01"), args[1:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, sql, bad = e.queries(), e.oracle_sql(), 0
    for name, q in queries.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            if name in sql:
                ok, said = compare(spark, folder, q, sql[name])
            else:
                ok, said = True, f"{q(spark, folder).count()} rows, no SQL"
        except Exception as x:  # noqa: BLE001
            ok, said = False, str(x)[:400]
        bad += not ok
        print("ok " if ok else "BAD", name, f"{time.time() - t:.1f}s", said, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
