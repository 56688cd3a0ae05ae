"""Tables at rest by layer: Parquet folders or catalog tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.contracts import CONTRACTS, LAYERS, TableContract
from ordermill.session import scratch_path
from ordermill.sinks.counted import Written, write_counted
from ordermill.sinks.snapshots import Versions
from ordermill.sources.files import path_exists

# the column that tells the parts of a table that is landed in increments
PART = "landing"


class Layers(Protocol):
    """Anywhere tables rest: Parquet folders, the catalog or a database."""

    def exists(self, spark: SparkSession, contract: TableContract) -> bool: ...

    def read(self, spark: SparkSession, contract: TableContract) -> DataFrame: ...

    def write(
        self,
        df: DataFrame,
        contract: TableContract,
        mode: str = "overwrite",
        metrics: Mapping[str, Column] | None = None,
        columns: Sequence[Column | str] | None = None,
    ) -> Written: ...


@dataclass(frozen=True)
class PathLayers:
    """``root/layer/table`` folders of Parquet; the layer comes from the table's contract.

    Tables are kept in published versions (``snapshots``), of which the last ``keep`` stay.
    """

    root: str
    keep: int = 2

    def path(self, contract: TableContract) -> str:
        return f"{self.root.rstrip('/')}/{contract.layer}/{contract.name}"

    def versions(self, spark: SparkSession, contract: TableContract) -> Versions:
        return Versions(spark, self.path(contract))

    def exists(self, spark: SparkSession, contract: TableContract) -> bool:
        current = self.versions(spark, contract).current()
        return current is not None and any(
            path_exists(spark, f"{current.path}/{files}") for files in ("part-*", "*/part-*")
        )

    def read(
        self, spark: SparkSession, contract: TableContract, version: int | None = None
    ) -> DataFrame:
        """The current version or that of a number, with the column it is stored by if it has one.

        The frame stays with the version that it was made on, whatever is published later.
        """
        found = self.versions(spark, contract).current(version)
        # a table that is not there fails as any path that is not there
        return spark.read.parquet(found.path if found else self.path(contract)).drop(PART)

    def recover(self, spark: SparkSession, contracts: Iterable[TableContract]) -> list[str]:
        """Undo what a lost writer of these tables left half done; before the first write."""
        return [name for c in contracts for name in self.versions(spark, c).recover()]

    def _writer(self, df: DataFrame, contract: TableContract):
        writer = df.write
        for column in contract.looked_up:
            # as large as the file's keys need
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(
                "parquet.bloom.filter.adaptive.enabled", "true"
            )
        return writer

    def write(
        self,
        df: DataFrame,
        contract: TableContract,
        mode: str = "overwrite",
        metrics: Mapping[str, Column] | None = None,
        columns: Sequence[Column | str] | None = None,
    ) -> Written:
        """Write with any save mode: overwrite, append, ignore or error.

        An overwrite is a new version, published once it is whole: whatever fails before, the
        table stays as it was. An append adds to the current version.
        """

        def write(d: DataFrame) -> None:
            versions = self.versions(d.sparkSession, contract)
            current = versions.current()
            writer = self._writer(d, contract)
            if contract.stored_by in d.columns:
                writer = writer.partitionBy(contract.stored_by)
            if current and mode != "overwrite":
                writer.mode(mode).parquet(current.path)
                return
            fresh = versions.fresh()
            writer.mode("error").parquet(fresh)
            versions.publish(fresh)
            versions.tidy(self.keep)

        return write_counted(df, write, metrics, columns)

    def read_part(self, spark: SparkSession, contract: TableContract, part: str) -> DataFrame:
        """One named part; the others are not listed."""
        return spark.read.parquet(f"{self.versions(spark, contract).current().path}/{PART}={part}")

    def write_part(
        self,
        df: DataFrame,
        contract: TableContract,
        part: str,
        metrics: Mapping[str, Column] | None = None,
        columns: Sequence[Column | str] | None = None,
    ) -> Written:
        """Write a named part of the table; written again, it takes its own place.

        A table is kept either whole or in parts.
        """

        def write(d: DataFrame) -> None:
            versions = self.versions(d.sparkSession, contract)
            current = versions.current() or versions.publish(versions.fresh())
            if path_exists(d.sparkSession, f"{current.path}/part-*"):
                raise ValueError(f"{contract.qualified_name} is kept whole, not in parts")
            (
                self._writer(d.withColumn(PART, F.lit(part)), contract)
                .partitionBy(PART)
                .option("partitionOverwriteMode", "dynamic")
                .mode("overwrite")
                .parquet(current.path)
            )

        return write_counted(df, write, metrics, columns)


@dataclass(frozen=True)
class CatalogLayers:
    """One schema per layer in the session catalog.

    Tables are created from their contracts and then only filled, so an overwrite keeps
    the declared types. ``buckets`` says by table which column its rows are dealt by, and into
    how many buckets: tables with the same number of buckets on their common key are joined
    and grouped by it without a shuffle. The number is fixed when a table is created.
    """

    location: str | None = None
    buckets: Mapping[str, tuple[str, int]] = field(default_factory=dict)

    def create(self, spark: SparkSession, contracts=tuple(CONTRACTS.values())) -> None:
        """Create schemas and tables that do not exist yet; repeating it changes nothing."""
        for layer in LAYERS:
            place = f" LOCATION '{self.location.rstrip('/')}/{layer}'" if self.location else ""
            spark.sql(f"CREATE SCHEMA IF NOT EXISTS {layer}{place}")
        for c in contracts:
            columns = ", ".join(
                f"`{f.name}` {f.dataType.simpleString()}" for f in c.schema.fields
            )
            dealt = ""
            if c.name in self.buckets:
                column, n = self.buckets[c.name]
                dealt = f" CLUSTERED BY (`{column}`) SORTED BY (`{column}`) INTO {n} BUCKETS"
            spark.sql(f"CREATE TABLE IF NOT EXISTS {c.qualified_name} ({columns}) USING parquet{dealt}")

    def exists(self, spark: SparkSession, contract: TableContract) -> bool:
        return spark.catalog.tableExists(contract.qualified_name)

    def read(self, spark: SparkSession, contract: TableContract) -> DataFrame:
        return spark.table(contract.qualified_name)

    def write(
        self,
        df: DataFrame,
        contract: TableContract,
        mode: str = "overwrite",
        metrics: Mapping[str, Column] | None = None,
        columns: Sequence[Column | str] | None = None,
    ) -> Written:
        """Fill the table by column name; mode is overwrite or append.

        Spark empties a table before it fills it anew, so an overwrite goes through the
        shared scratch folder: the source is read to its end before the table is touched.
        """
        if mode not in ("overwrite", "append"):
            raise ValueError(f"catalog tables take overwrite or append, not {mode}")

        def write(d: DataFrame) -> None:
            ordered = d.select(*contract.schema.names)
            if mode == "overwrite":
                staged = scratch_path(d.sparkSession, contract.name)
                ordered.write.parquet(staged)
                ordered = d.sparkSession.read.parquet(staged)
            if contract.name in self.buckets:
                column, n = self.buckets[contract.name]
                # one file per bucket and write; a hot key is one bucket's, as any bucketing has it
                ordered = ordered.repartition(n, column)
            ordered.write.insertInto(contract.qualified_name, overwrite=mode == "overwrite")

        return write_counted(df, write, metrics, columns)
