"""Run catalogued queries on Spark and their SQL on DuckDB and compare all rows."""

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{root}/{name}.parquet'")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(round(value, 9))
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda at: names[at])
    return sorted(
        (tuple(cell(row[at]) for at in order) for row in data),
        key=lambda row: tuple((c is not None, c or "") for c in row),
    )


def compare(spark, con, root, build, sql):
    """None if both agree, else a text about the first difference."""
    df = build(spark, root)
    got = rows(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return None
    have, need = set(got), set(want)
    return f"{len(got)} rows, expected {len(want)}; extra {sorted(map(str, have - need))[:3]}; missing {sorted(map(str, need - have))[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries

    root, only = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, oracles = connect(root), oracle_sql()
    for name, build in queries().items():
        if (only and name not in only) or name not in oracles:
            continue
        start = time.perf_counter()
        try:
            problem = compare(spark, con, root, build, oracles[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        print(name, "ok" if problem is None else "DIFFERS " + problem, round(time.perf_counter() - start, 1), flush=True)
