"""Run every registered query next to its SQL twin and report differences.

usage: python -m checks.compare SF_DIR [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.registry import QUERIES


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=repr)


def main(sf_dir: str, names: list[str]) -> int:
    spark = session()
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    wrong = 0
    for name in names or QUERIES:
        begin = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            columns = sorted(df.columns)
            got = normal([tuple(r) for r in df.select(*columns).collect()])
        except Exception as problem:  # noqa: BLE001
            print(f"FAIL {name}: {str(problem)[:1500]}")
            wrong += 1
            continue
        seconds = time.time() - begin
        if name not in ORACLE:
            print(f"rows {name} {len(got)} {seconds:.1f}s")
            continue
        try:
            quoted = ", ".join(f'"{c}"' for c in columns)
            want = normal(con.execute(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall())
        except Exception as problem:  # noqa: BLE001
            print(f"FAIL {name} oracle: {str(problem)[:800]}")
            wrong += 1
            continue
        same = got == want
        wrong += not same
        print(f"{'ok  ' if same else 'DIFF'} {name} {len(got)} {len(want)} {seconds:.1f}s")
        if not same:
            print("  only spark ", [r for r in got if r not in set(want)][:2])
            print("  only oracle", [r for r in want if r not in set(got)][:2])
    return wrong


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
