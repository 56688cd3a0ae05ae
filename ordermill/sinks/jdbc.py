"""JDBC writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ordermill.contracts import TableContract
from ordermill.sinks.counted import Written, write_counted
from ordermill.sources.jdbc import JdbcConnection, RangeSplit, read_jdbc


def column_types(schema: StructType) -> str:
    """VARCHAR(n) for bounded strings, for tables that Spark has to create."""
    return ", ".join(
        f"{f.name} VARCHAR({f.metadata['max_length']})"
        for f in schema.fields
        if isinstance(f.dataType, StringType) and "max_length" in f.metadata
    )


def as_declared(df: DataFrame, contract: TableContract) -> DataFrame:
    """Columns whose database type is narrower than the one at rest, cast to it."""
    narrow = {
        f.name: F.col(f.name).cast(f.metadata["database_type"])
        for f in contract.schema.fields
        if "database_type" in f.metadata and f.name in df.columns
    }
    return df.withColumns(narrow) if narrow else df


@dataclass(frozen=True)
class JdbcLayers:
    """Database tables, the database schema being the layer.

    ``splits`` says by table how to read it in parallel; without one a table comes through one
    connection. ``max_connections`` bounds the tasks that write. Overwrite truncates instead of
    dropping, so declared types and keys stay. A database refuses to truncate a table that a
    foreign key refers to; the landing job fills such tables with ``append_missing``. Spark
    commits each partition on its own: a task retried after its commit inserts again, so keep the primary key in the
    database, which turns such a repeat into an error instead of a duplicate.
    """

    connection: JdbcConnection
    max_connections: int = 16
    batch_size: int = 10_000
    splits: Mapping[str, RangeSplit] = field(default_factory=dict)

    def write_options(self, contract: TableContract) -> dict[str, str]:
        options = self.connection.table_options(contract.layer, contract.name)
        options |= {
            "truncate": "true",
            "numPartitions": str(self.max_connections),
            "batchsize": str(self.batch_size),
        }
        types = column_types(contract.schema)
        if types:
            options["createTableColumnTypes"] = types
        return options

    def exists(self, spark: SparkSession, contract: TableContract) -> bool:
        """Whether the database lists the table in its standard catalog."""
        listed = (
            "(SELECT table_name FROM information_schema.tables WHERE table_schema = "
            f"'{contract.layer}' AND table_name = '{contract.name}') AS listed"
        )
        options = self.connection.table_options(contract.layer, contract.name)
        return not spark.read.format("jdbc").options(**options | {"dbtable": listed}).load().isEmpty()

    def read(
        self,
        spark: SparkSession,
        contract: TableContract,
        predicates: Sequence[str] | None = None,
    ) -> DataFrame:
        split = None if predicates else self.splits.get(contract.name)
        return read_jdbc(
            spark, self.connection, contract.name, contract.layer, split, predicates
        )

    def write(
        self,
        df: DataFrame,
        contract: TableContract,
        mode: str = "overwrite",
        metrics: Mapping[str, Column] | None = None,
        columns: Sequence[Column | str] | None = None,
    ) -> Written:
        """Write with any save mode; failures propagate, a count beyond INTEGER among them.

        The rows are spread over ``max_connections`` tasks by a shuffle, so the work
        above the write keeps its own parallelism.
        """
        options = self.write_options(contract)
        spread = df.repartition(self.max_connections)
        return write_counted(
            spread,
            lambda d: as_declared(d, contract)
            .write.format("jdbc")
            .options(**options)
            .mode(mode)
            .save(),
            metrics,
            columns,
        )
