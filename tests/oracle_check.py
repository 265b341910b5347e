"""python tests/oracle_check.py [DIR] [NAME...]: each query against its SQL in DuckDB, on the tables in DIR."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


def main(folder: str, names: list[str]) -> int:
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, f in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = f(spark, folder)
            got = canonical(df.columns, [tuple(r) for r in df.collect()])
            if name in entry.oracle_sql():
                cur = con.execute(entry.oracle_sql()[name])
                columns = [c[0] for c in cur.description]
                want = canonical(columns, cur.fetchall())
                ok = sorted(columns) == sorted(df.columns) and got == want
                bad += not ok
                print(f"{'ok  ' if ok else 'DIFF'} {name}: {len(got)} rows, {time.time() - began:.1f} s" + ("" if ok else f"\n  spark {df.columns} {got[:3]}\n  sql   {columns} {len(want)} {want[:3]}"), flush=True)
            else:
                print(f"rows {name}: {len(got)}, {time.time() - began:.1f} s", flush=True)
        except Exception as e:
            bad += 1
            print(f"FAIL {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
