"""Run a registered query on Spark and its SQL twin on DuckDB and compare them."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("driftloom-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.ansi.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, query, sql, sf_dir) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    left = canon(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = canon([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return False, f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return False, f"rows {len(left[1])} vs {len(right[1])}"
    for a, b in zip(left[1], right[1], strict=True):
        if a != b:
            bad = sum(x != y for x, y in zip(left[1], right[1], strict=True))
            return False, f"{bad} of {len(left[1])} rows differ, first\n   {left[0]}\n   {a}\n   {b}"
    return True, f"{len(left[1])} rows"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{argv[0]}"
    wanted = argv[1:]
    spark, con = session(), duck(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracle:
                ok, note = compare(spark, con, query, oracle[name], sf_dir)
            else:
                rows = query(spark, sf_dir).collect()
                ok, note = True, f"{len(rows)} rows (no SQL twin) {rows[:1]}"
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {time.time() - t:6.2f}s {note}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(1 if main(sys.argv[1:]) else 0)
