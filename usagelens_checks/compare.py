"""Runs registered queries against their SQL twins: python -m usagelens_checks.compare [names]."""

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from usagelens_checks.oracle import ORACLE
from usagelens_checks.queries import QUERIES
from usagelens_checks.session import ensure_folder

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        if os.path.exists(f"{sf_dir}/{name}.parquet"):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _key(row):
    return tuple((value is not None, str(type(value).__name__), value if value is not None else 0) for value in row)


def difference(spark, connection, name, sf_dir):
    """Empty text if the query equals its twin, else what differs."""
    result = QUERIES[name](spark, sf_dir)
    columns = sorted(result.columns)
    ours = [tuple(row[column] for column in columns) for row in result.collect()]
    if name not in ORACLE:
        return "" if ours else "no rows"
    cursor = connection.execute(ORACLE[name])
    names = [item[0] for item in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    order = [names.index(column) for column in columns]
    theirs = [tuple(row[i] for i in order) for row in cursor.fetchall()]
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    ours, theirs = sorted(ours, key=_key), sorted(theirs, key=_key)
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} rows differ: {columns} {wrong[:2]}" if wrong else ""


def main(names):
    sf_dir = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", os.environ.get("CHECK_ZONE", "UTC")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_folder(spark)
    connection = duck(sf_dir)
    bad = 0
    for name in names or QUERIES:
        begin = time.time()
        try:
            found = difference(spark, connection, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok  '} {name} {time.time() - begin:.1f}s {found}", flush=True)
    print(f"{bad} failed", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
