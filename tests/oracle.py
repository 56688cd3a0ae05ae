"""Run a registered query in Spark and its check SQL in DuckDB and compare every row.

    python -m tests.oracle [data folder] [query or setting=value ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(r) for r in df.select(*names).collect())


def oracle_rows(con, sql: str) -> tuple[list[str], Counter]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    rows = Counter(tuple(r[i] for i in order) for r in result.fetchall())
    return [columns[i] for i in order], rows


def differences(df, con, sql: str) -> list[str]:
    """Empty when column names, row count and all values agree."""
    names, got = spark_rows(df)
    expected_names, expected = oracle_rows(con, sql)
    if names != expected_names:
        return [f"columns {names} != {expected_names}"]
    extra, missing = got - expected, expected - got
    if extra or missing:
        return [
            f"{sum(extra.values())} extra, {sum(missing.values())} missing of "
            f"{sum(expected.values())}; extra {list(extra)[:2]}, missing {list(missing)[:2]}"
        ]
    return []


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from ordermill.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = [a for a in sys.argv[2:] if "=" not in a]
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **dict(a.split("=", 1) for a in sys.argv[2:] if "=" in a),
    }
    spark = build_session("oracle", "local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(folder), oracle_sql(), 0
    for name, run in queries().items():
        if name not in oracles or (wanted and name not in wanted):
            continue
        started = time.time()
        try:
            problems = differences(run(spark, folder), con, oracles[name])
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.2f}s", *problems)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main()
