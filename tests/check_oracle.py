"""Compare registered queries with their SQL on the given tables.

usage: python tests/check_oracle.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(con, df, sql):
    """Empty when both results agree, else what differs."""
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    got = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(want_columns):
        return f"columns {sorted(df.columns)} != {sorted(want_columns)}"
    a, b = rows_of(df.columns, got), rows_of(want_columns, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"row\n  spark {x}\n  sql   {y}"[:1500]
    return ""


def main():
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress","false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if len(args) > 1 and name not in args[1:]:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                diff, n = compare(con, df, oracles[name]), ""
            else:
                diff, n = "", f"{df.count()} (no sql)"
        except Exception as e:  # report and go on
            diff, n = f"{type(e).__name__}: {str(e)[:1500]}", ""
        bad += bool(diff)
        print(f"{'BAD ' if diff else 'ok  '} {name} {n} {time.time() - start:.1f}s {diff}", flush=True)
    print(f"{bad} bad of {len(queries)}; without sql: {sorted(set(queries) - set(oracles))}")


if __name__ == "__main__":
    main()
