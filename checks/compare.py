"""Run the registered queries against their SQL: python -m checks.compare [folder] [query ...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from datetime import datetime
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

from tidemark.session import session

from .oracles import ORACLES
from .queries import REGISTERED


def _plain(value):
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    database = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        database.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return database


def compare(spark: SparkSession, database, folder: str, name: str) -> str:
    """Empty if the query gives the rows of its SQL, else what differs."""
    df = REGISTERED[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return ""
    result = database.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    want = rows_of(columns, result.fetchall())
    if got == want:
        return "" if got else "no rows"
    extra, missing = got - want, want - got
    return (
        f"{got.total()} rows against {want.total()}; {extra.total()} too many, "
        f"like {list(extra)[:2]}; {missing.total()} missing, like {list(missing)[:2]}"
    )


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(REGISTERED)
    spark = session(
        **{
            "spark.master": "local[8]",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        }
    )
    spark.sparkContext.setLogLevel("ERROR")
    database = connection(folder)
    failed = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, database, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{name:28} {time.time() - start:6.1f}s  {problem or 'ok'}", flush=True)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
