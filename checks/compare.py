"""Run queries and their SQL side by side: ``python -m checks.compare SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from gradus.shipping import ship
from gradus.storage import release

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8", partitions: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="gradus-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark, os.path.dirname(os.path.abspath(__file__)))
    return spark


sql_seconds: dict[str, float] = {}


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "asDict"):
        return str({k: _cell(v) for k, v in value.asDict().items()})
    if isinstance(value, (list, tuple)):
        return str([_cell(v) for v in value])
    return value if value is None else str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def compare(df, connection, statement: str) -> str | None:
    """None when equal, otherwise what differs."""
    started = time.time()
    found = connection.execute(statement)
    columns = [d[0] for d in found.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} but SQL has {sorted(columns)}"
    expected = rows_of(columns, found.fetchall())
    sql_seconds[statement] = time.time() - started
    actual = rows_of(df.columns, df.collect())
    if actual == expected:
        return None
    missing, extra = expected - actual, actual - expected
    return (
        f"{sum(actual.values())} rows, SQL {sum(expected.values())}; "
        f"missing {list(missing)[:2]!s:.400}; extra {list(extra)[:2]!s:.400}"
    )


def main() -> None:
    from checks import ORACLES, QUERIES

    sf_dir, *names = sys.argv[1:]
    spark, connection = session(os.environ.get("CORES", "8")), duck(sf_dir)
    bad = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(df, connection, ORACLES[name])
                state = "ok" if problem is None else f"DIFFERS {problem}"
            else:
                state = f"{len(df.collect())} rows, no SQL"
        except Exception as failure:
            state = f"ERROR {type(failure).__name__} {str(failure)[:600]}"
        release(spark)
        bad += state.startswith(("DIFFERS", "ERROR"))
        in_sql = sql_seconds.get(ORACLES.get(name), 0.0)
        spent = time.time() - started - in_sql
        print(f"{name:28s} {spent:6.2f}s sql {in_sql:6.2f}s {state}", flush=True)
    print(f"{bad} of {len(names or QUERIES)} bad")


if __name__ == "__main__":
    main()
