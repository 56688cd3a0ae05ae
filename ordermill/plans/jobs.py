"""The batch jobs: land the raw files, check them against their contracts, build the marts."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.contracts import (
    CUSTOMER_METRICS,
    DAILY_SALES,
    FINDINGS,
    ORDER_ITEMS,
    ORDERS,
    PRODUCT_PERFORMANCE,
    PRODUCTS,
    RAW_TABLES,
    REFERENCED,
    REJECTS,
    TableContract,
)
from ordermill.operators.quality import conform, contract_findings
from ordermill.operators.relational import DELIVERED
from ordermill.plans.marts import customer_metrics, daily_sales, product_performance
from ordermill.sinks.append import append_missing
from ordermill.sinks.counted import Written
from ordermill.sinks.jdbc import JdbcLayers
from ordermill.sinks.layers import Layers
from ordermill.sources.files import CheckedCsv
from ordermill.sources.registry import LOADED, LoadResult, RawRead, load_raw, loaded_frames

# names under which a landing write counts rejected cells and broken lines
REJECTED, BROKEN = "rejected ", "broken lines"


class NoDataError(RuntimeError):
    """Nothing could be loaded."""


@dataclass(frozen=True)
class LandingReport:
    tables: dict[str, LoadResult]

    def landed(self) -> list[LoadResult]:
        return [r for r in self.tables.values() if r.status == LOADED]


def _without_keys(target: Layers, contract: TableContract) -> bool:
    """Whether the target keeps this table's rows in place because others refer to them."""
    return isinstance(target, JdbcLayers) and contract.name in REFERENCED


def landing_metrics(read: CheckedCsv) -> dict[str, Column]:
    """Rejected cells by column, broken lines and nulls by column, counted in one pass."""
    metrics = {f"{REJECTED}{c}": F.count_if(bad) for c, bad in read.rejections().items()}
    metrics[BROKEN] = F.count_if(read.broken())
    for f in read.schema:
        metrics[f.name] = F.count_if(F.col(f"`{f.name}`").try_cast(f.dataType).isNull())
    return metrics


def land_raw(
    spark: SparkSession,
    root: str,
    target: Layers,
    pattern: str = "{table}.csv",
    infer: bool = False,
    aliases: Mapping[str, Mapping[str, str]] | None = None,
) -> LandingReport:
    """Land every raw file in its layer and report its rows, nulls and rejected cells.

    One scan per file: the write counts as rows pass. Only where something was rejected, a
    second scan keeps the text of those rows in the rejects table. A database table that a
    foreign key refers to is filled with the rows it lacks; all others are replaced.
    """
    rejected: list[DataFrame] = []

    def land(read: RawRead, contract: TableContract) -> tuple[DataFrame, Written]:
        if isinstance(read, DataFrame):
            frame, columns = read, None
            metrics = {c: F.count_if(F.col(f"`{c}`").isNull()) for c in frame.columns}
        else:
            frame, columns, metrics = read.text, read.typed(), landing_metrics(read)
        if _without_keys(target, contract):
            # the rows that are appended are not all rows of the file, so these are counted apart
            counted = frame.agg(*[m.alias(name) for name, m in metrics.items()]).first().asDict()
            shaped = frame.select(*columns) if columns else frame
            written = Written(append_missing(shaped, contract, target).rows, counted)
        else:
            written = target.write(frame, contract, metrics=metrics, columns=columns)
        counted = written.metrics
        if not isinstance(read, DataFrame) and any(
            n for name, n in counted.items() if name == BROKEN or name.startswith(REJECTED)
        ):
            rejected.append(read.rejects(contract.name))
        return target.read(spark, contract), written

    results = load_raw(spark, root, land, pattern, infer, aliases)
    if not loaded_frames(results):
        raise NoDataError(f"no raw table could be loaded from {root}")
    nothing = spark.createDataFrame([], REJECTS.schema)
    target.write(reduce(DataFrame.unionByName, rejected, nothing), REJECTS)
    return LandingReport(results)


def landed_rejects(spark: SparkSession, report: LandingReport) -> DataFrame:
    """Per table and column, the cells whose text is no value of the declared type.

    Lines with too few or too many cells are counted without a column.
    """
    rows = []
    for r in report.landed():
        for name, n in r.written.metrics.items():
            if n and name == BROKEN:
                rows.append((r.table, None, n))
            elif n and name.startswith(REJECTED):
                rows.append((r.table, name.removeprefix(REJECTED), n))
    return spark.createDataFrame(rows, "table_name string, column_name string, rejected bigint")


def landed_counts(spark: SparkSession, report: LandingReport) -> DataFrame:
    """One row per landed table."""
    rows = [(r.table, r.written.rows) for r in report.landed()]
    return spark.createDataFrame(rows, "table_name string, row_count bigint")


def landed_nulls(spark: SparkSession, report: LandingReport) -> DataFrame:
    """The columns that hold nulls, as the writes saw them."""
    rows = [
        (r.table, c, n)
        for r in report.landed()
        for c, n in r.written.metrics.items()
        if n and c != BROKEN and not c.startswith(REJECTED)
    ]
    return spark.createDataFrame(rows, "table_name string, column_name string, null_count bigint")


def build_marts(
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    target: Layers,
    status: str = DELIVERED,
    mode: str = "overwrite",
) -> dict[str, int]:
    """Write the three marts to their layers; rows written to each.

    One action per mart, submitted together, so that one mart's last tasks leave no executor
    idle. The marts share no stored intermediate: each reads the few columns it needs. A
    failure reaches the caller once all three have ended.
    """
    marts = [
        (CUSTOMER_METRICS, customer_metrics(orders, items, products, status)),
        (DAILY_SALES, daily_sales(orders, items, status)),
        (PRODUCT_PERFORMANCE, product_performance(orders, items, products, status)),
    ]

    def write(contract: TableContract, mart: DataFrame) -> int:
        return target.write(conform(mart, contract), contract, mode).rows

    spark = orders.sparkSession
    with ThreadPoolExecutor(len(marts)) as pool:
        running = [
            (c.name, pool.submit(inheritable_thread_target(spark)(write), c, mart))
            for c, mart in marts
        ]
    return {name: done.result() for name, done in running}


def mart_summary(spark: SparkSession, written: dict[str, int]) -> DataFrame:
    """Counts of a mart run under their reporting names."""
    names = {
        "customers_processed": CUSTOMER_METRICS.name,
        "days_analyzed": DAILY_SALES.name,
        "products_analyzed": PRODUCT_PERFORMANCE.name,
    }
    rows = [(metric, written[table]) for metric, table in names.items()]
    return spark.createDataFrame(rows, "metric string, row_count bigint")


def run_marts(
    spark: SparkSession, source: Layers, target: Layers, status: str = DELIVERED
) -> dict[str, int]:
    """Build all marts from the raw layer; an error stops the run and reaches the caller."""
    orders, items, products = (source.read(spark, c) for c in (ORDERS, ORDER_ITEMS, PRODUCTS))
    return build_marts(orders, items, products, target, status)


def check_raw(spark: SparkSession, source: Layers, target: Layers) -> int:
    """Check all landed raw tables against their contracts; the number of findings written."""
    frames = {c.name: source.read(spark, c) for c in RAW_TABLES if source.exists(spark, c)}
    contracts = [c for c in RAW_TABLES if c.name in frames]
    return target.write(contract_findings(frames, contracts), FINDINGS).rows
