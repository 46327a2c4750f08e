"""Runs queries and their SQL side by side: python -m tests.oracle SF_DIR [NAME...]."""

import datetime
import math
import sys
import time
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else 0.0 if v == 0 else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


def close(a, b):
    return a == b or (isinstance(a, float | int) and isinstance(b, float | int) and not isinstance(a, bool) and abs(a - b) <= 2e-6 * max(1, abs(a)))


def connect(sf_dir):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return c


def differ(spark, connection, sf_dir, name, query, sql):
    """None if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    found = connection.execute(sql)
    columns = [d[0] for d in found.description]
    theirs = rows_of(columns, found.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs, strict=True):
        if len(a) != len(b) or not all(map(close, a, b)):
            return f"{sorted(columns)}: {a} against {b}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    base = connect(sys.argv[1])
    queries, oracle = entry.queries(), entry.oracle_sql()
    for n in sys.argv[2:] or sorted(oracle):
        began = time.time()
        try:
            said = differ(session, base, sys.argv[1], n, queries[n], oracle[n])
        except (Exception, SystemExit) as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        print(n, "ok" if said is None else f"DIFFERS {said}", f"{time.time() - began:.1f}", flush=True)
