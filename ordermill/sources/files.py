"""CSV reading and path checks through the Hadoop file system."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_BROKEN = "_broken_line"


class HeaderError(ValueError):
    """A header lacks a declared column or names an unknown one."""


def path_exists(spark: SparkSession, path: str) -> bool:
    """True if any file or folder matches ``path``, on whatever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    matches = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop_path)
    return bool(matches)


@dataclass(frozen=True)
class CheckedCsv:
    """A CSV file read as text: its declared columns, and what could not be taken over."""

    text: DataFrame
    schema: StructType

    def _bad(self, field: StructField) -> Column:
        value = F.col(f"`{field.name}`")
        return value.isNotNull() & value.try_cast(field.dataType).isNull()

    def rejections(self) -> dict[str, Column]:
        """Per column, whether a cell holds text that is no value of the declared type."""
        return {
            f.name: self._bad(f) for f in self.schema if not isinstance(f.dataType, StringType)
        }

    def broken(self) -> Column:
        """Whether a line has too few or too many cells."""
        return F.col(_BROKEN).isNotNull()

    def typed(self) -> list[Column]:
        """The declared columns; a rejected cell is null."""
        return [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name, metadata=f.metadata) for f in self.schema]

    def rejects(self, table: str) -> DataFrame:
        """Rows with a rejected cell or a broken line, with their text as read."""
        names = [F.when(bad, F.lit(name)) for name, bad in self.rejections().items()]
        found = self.text.withColumn(
            "rejected_columns", F.filter(F.array(*names), lambda name: name.isNotNull())
        )
        raw = F.to_json(F.struct(*[F.col(f"`{n}`") for n in self.schema.names]))
        return found.filter((F.size("rejected_columns") > 0) | self.broken()).select(
            F.lit(table).alias("table_name"),
            "rejected_columns",
            self.broken().alias("broken_line"),
            F.coalesce(F.col(_BROKEN), raw).alias("raw_text"),
        )


def read_checked_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType,
    aliases: Mapping[str, str] | None = None,
) -> CheckedCsv:
    """CSV whose columns are found by their header names, in any order.

    ``aliases`` maps header names to declared ones. A missing, repeated or unknown header
    raises ``HeaderError``; files of one folder must share one header, else the read fails.
    """
    reader = spark.read.option("header", True)
    header = reader.csv(path).columns
    named = [(aliases or {}).get(h.strip(), h.strip()) for h in header]
    missing = [n for n in schema.names if n not in named]
    unknown = [n for n in named if n not in schema.names]
    if missing or unknown or len(set(named)) < len(named):
        raise HeaderError(f"{path}: missing {missing}, unknown {unknown}, header {header}")
    as_text = StructType([*(StructField(h, StringType()) for h in header), StructField(_BROKEN, StringType())])
    text = (
        reader.schema(as_text)
        .option("enforceSchema", False)
        .option("columnNameOfCorruptRecord", _BROKEN)
        .csv(path)
    )
    return CheckedCsv(text.toDF(*named, _BROKEN), schema)


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with a header row.

    With a schema, columns are found by header name and a cell that does not parse becomes
    null; ``read_checked_csv`` tells which. Without one, types are inferred from all rows,
    which costs one more scan and loses leading zeros.
    """
    if schema is None:
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    checked = read_checked_csv(spark, path, schema)
    return checked.text.select(*checked.typed())
