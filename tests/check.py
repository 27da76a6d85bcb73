"""Compare registered queries with their SQL twins: ``python tests/check.py [sf] [name...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def database(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set threads to 8")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def normal(value):
    if value is None:
        return "~"
    if hasattr(value, "as_integer_ratio") or hasattr(value, "quantize"):
        number = float(value)
        return "nan" if number != number else f"{number + 0.0:.6g}"
    if isinstance(value, dict):
        return str(sorted((str(k), normal(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return str([normal(v) for v in value])
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark, con, sf, name, fn, sql):
    start = time.time()
    frame = fn(spark, sf)
    mine = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - start
    if sql is None:
        return f"rows-only n={len(mine[1])}", spent, len(mine[1]) > 0
    start = time.time()
    rel = con.sql(sql)
    other = rows_of(rel.columns, rel.fetchall())
    duck = time.time() - start
    if mine[0] != other[0]:
        return f"COLUMNS {mine[0]} vs {other[0]}", spent, False
    if mine[1] != other[1]:
        extra = [r for r in mine[1] if r not in set(other[1])][:3]
        lack = [r for r in other[1] if r not in set(mine[1])][:3]
        return f"ROWS {len(mine[1])} vs {len(other[1])}\n    spark only {extra}\n    sql only   {lack}", spent, False
    return f"ok n={len(mine[1])} sql={duck:.1f}s", spent, True


def main(argv):
    sf = f"/root/testdata/sf{argv[0]}" if argv else "/root/testdata/sf0.01"
    import __spark_entry__ as entry

    names = argv[1:]
    spark = session()
    oracle = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            text, spent, ok = compare(spark, database(sf), sf, name, fn, oracle.get(name))
        except Exception as exc:  # report and go on
            text, spent, ok = f"ERROR {str(exc)[:1500]}", 0.0, False
        if not ok:
            bad.append(name)
        print(f"{name:34s} {spent:6.1f}s {text}", flush=True)
    print("FAILED:", bad)
    return bool(bad)


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
