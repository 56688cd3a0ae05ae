"""JDBC reads, in parallel when the caller says how to split the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ordermill.contracts import RAW


@dataclass(frozen=True)
class JdbcConnection:
    """Where the database is; credentials come from the caller."""

    url: str
    user: str = ""
    password: str = field(default="", repr=False)
    driver: str = "org.postgresql.Driver"
    options: dict[str, str] = field(default_factory=dict)

    def table_options(self, layer: str, table: str) -> dict[str, str]:
        options = {"url": self.url, "driver": self.driver, "dbtable": f"{layer}.{table}"}
        if self.user:
            options |= {"user": self.user, "password": self.password}
        return options | self.options


@dataclass(frozen=True)
class RangeSplit:
    """Equal strides over a numeric, date or timestamp column.

    The bounds set the strides only; rows outside them and rows with a null are read by
    the first and last partitions.
    """

    column: str
    lower: str
    upper: str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.partitions),
        }


def read_jdbc(
    spark: SparkSession,
    connection: JdbcConnection,
    table: str,
    layer: str = RAW,
    split: RangeSplit | None = None,
    predicates: Sequence[str] | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """One database table. Filters and column choice are pushed to the database.

    Without ``split`` or ``predicates`` the whole table comes through one connection.
    ``predicates`` gives one WHERE clause per partition, for string keys; they must
    cover every row exactly once.
    """
    if split and predicates:
        raise ValueError("give a range split or predicates, not both")
    options = connection.table_options(layer, table) | {"fetchsize": str(fetch_size)}
    if predicates:
        properties = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(
            options["url"], options["dbtable"], predicates=list(predicates), properties=properties
        )
    if split:
        options |= split.options()
    return spark.read.format("jdbc").options(**options).load()
