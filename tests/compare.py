"""Runs queries and their SQL side by side: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (decimal.Decimal, datetime.date, str)):
        return f"{type(value).__name__}:{value}"
    if isinstance(value, float):
        return f"float:{value!r}"
    return f"int:{value}"


def rows_of_sql(sf_dir: str, sql: str):
    with duckdb.connect() as db:
        for name in TABLES:
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        result = db.sql(sql)
        names = result.columns
        return names, result.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def difference(frame, sf_dir: str, sql: str) -> str | None:
    got_names, got = normal(frame.columns, frame.collect())
    want_names, want = normal(*rows_of_sql(sf_dir, sql))
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}; only here {list(set(got) - set(want))[:2]}; only SQL {list(set(want) - set(got))[:2]}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session()
    sqls = entry.oracle_sql()
    bad = 0
    for name, build in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            problem = difference(build(spark, folder), folder, sqls[name]) if name in sqls else "no SQL"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{name:24s} {time.time() - start:6.1f}s {'ok' if problem is None else problem[:1500]}", flush=True)
    print("bad:", bad)
