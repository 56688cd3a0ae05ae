"""Command line for the jobs.

    python -m ordermill land  --raw <folder> --warehouse <folder> [--increment]
    python -m ordermill check --warehouse <folder>
    python -m ordermill marts --warehouse <folder>
    python -m ordermill live  --incoming <folder> --checkpoint <folder> --warehouse <folder>

or ``spark-submit --py-files ordermill.zip ordermill/__main__.py`` with the same options.

With ``--jdbc-url`` the tables rest in a database instead of Parquet folders; user and
password come from ORDERMILL_DB_USER and ORDERMILL_DB_PASSWORD. With ``--catalog`` they rest in
the session's catalog. ``live`` reads Parquet files of incoming orders and appends, to its end
or, with ``--every``, for as long as it runs.
"""

from __future__ import annotations

import argparse
import os
import sys

from ordermill.contracts import (
    FINDINGS,
    LANDED_FILES,
    LIVE_ORDERS,
    MART_TABLES,
    RAW_TABLES,
    REJECTS,
)
from ordermill.plans import jobs
from ordermill.plans.increments import land_increment
from ordermill.session import build_session
from ordermill.sinks.jdbc import JdbcLayers
from ordermill.sinks.layers import CatalogLayers, Layers, PathLayers
from ordermill.sources.jdbc import JdbcConnection, RangeSplit
from ordermill.streaming import live_orders as live

# the tables that a job writes, where it undoes what a lost run before it left half done
WRITES = {
    "land": (*RAW_TABLES, REJECTS, LANDED_FILES),
    "check": (FINDINGS,),
    "marts": MART_TABLES,
    "live": (LIVE_ORDERS,),
}


def parse(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="ordermill")
    parser.add_argument("job", choices=["land", "check", "marts", "live"])
    parser.add_argument("--raw", help="folder of the raw CSV files (land)")
    parser.add_argument("--pattern", default="{table}.csv", help="file name of a raw table")
    parser.add_argument("--infer", action="store_true", help="infer CSV types from the data")
    parser.add_argument(
        "--increment", action="store_true", help="land only files not landed before (land)"
    )
    where = parser.add_mutually_exclusive_group(required=True)
    where.add_argument("--warehouse", help="root folder of the Parquet layers")
    where.add_argument("--jdbc-url", help="database that holds the layers")
    where.add_argument("--catalog", action="store_true", help="layers are schemas of the catalog")
    parser.add_argument("--jdbc-driver", default="org.postgresql.Driver")
    parser.add_argument(
        "--jdbc-connections", type=int, default=16, help="tasks that write to the database"
    )
    parser.add_argument(
        "--jdbc-split",
        action="append",
        default=[],
        type=split_of,
        metavar="TABLE:COLUMN:LOWER:UPPER:N",
        help="read a database table through N connections; may be repeated",
    )
    parser.add_argument("--incoming", help="folder of incoming live orders (live)")
    parser.add_argument("--checkpoint", help="folder of the stream's progress (live)")
    parser.add_argument("--every", help="run on, with a batch at this interval (live)")
    parser.add_argument(
        "--initial-partitions", type=int, help="partitions a shuffle starts with"
    )
    options = parser.parse_args(argv)
    if options.job == "land" and not options.raw:
        parser.error("land needs --raw")
    if options.increment and (options.infer or not options.warehouse):
        parser.error("--increment goes with --warehouse and declared types")
    if options.job == "live" and not (options.incoming and options.checkpoint):
        parser.error("live needs --incoming and --checkpoint")
    return options


def split_of(text: str) -> tuple[str, RangeSplit]:
    # times hold colons: the outer parts are cut off first
    table, column, rest = text.split(":", 2)
    bounds, _, partitions = rest.rpartition(":")
    lower, upper = _halves(bounds)
    return table, RangeSplit(column, lower, upper, int(partitions))


def _halves(bounds: str) -> tuple[str, str]:
    """Lower and upper bound; both have the same number of colons."""
    parts = bounds.split(":")
    middle = len(parts) // 2
    return ":".join(parts[:middle]), ":".join(parts[middle:])


def layers(options: argparse.Namespace) -> Layers:
    if options.warehouse:
        return PathLayers(options.warehouse)
    if options.catalog:
        return CatalogLayers()
    return JdbcLayers(
        JdbcConnection(
            options.jdbc_url,
            os.environ.get("ORDERMILL_DB_USER", ""),
            os.environ.get("ORDERMILL_DB_PASSWORD", ""),
            options.jdbc_driver,
        ),
        options.jdbc_connections,
        splits=dict(options.jdbc_split),
    )


def main(argv: list[str] | None = None) -> int:
    options = parse(argv)
    place = layers(options)
    spark = build_session(
        f"ordermill-{options.job}", initial_partitions=options.initial_partitions
    )
    try:
        if options.catalog:
            place.create(spark)
        if isinstance(place, PathLayers):
            place.recover(spark, WRITES[options.job])
        if options.job == "land":
            if options.increment:
                report = land_increment(spark, options.raw, place, options.pattern)
            else:
                report = jobs.land_raw(spark, options.raw, place, options.pattern, options.infer)
            for result in report.tables.values():
                rows = result.written.rows if result.written else ""
                print(result.table, result.status, rows, result.error or "")
            jobs.landed_nulls(spark, report).show(truncate=False)
            jobs.landed_rejects(spark, report).show(truncate=False)
        elif options.job == "check":
            print("findings", jobs.check_raw(spark, place, place))
        elif options.job == "live":
            incoming = live.file_stream(spark, options.incoming, live.INCOMING)
            trigger = {"processingTime": options.every} if options.every else live.ONCE
            live.upsert_stream(incoming, place, options.checkpoint, trigger).awaitTermination()
        else:
            jobs.mart_summary(spark, jobs.run_marts(spark, place, place)).show(truncate=False)
        return 0
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
