"""Tables on the way, and row numbers for decisions that fall on rows and not on their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermill.session import scratch_path


def numbered(documents: DataFrame) -> tuple[DataFrame, str]:
    """The rows with one more column that tells them apart, and its name.

    They are written to the shared folder and read again, so a row's number stays the same
    however often and by whichever task it is read.
    """
    spark = documents.sparkSession
    row = "_row"
    while row in documents.columns:
        row = f"_{row}"
    found = documents.withColumn(row, F.monotonically_increasing_id())
    path = scratch_path(spark, "rows")
    found.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(found.schema).parquet(path), row


def stored(frame: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows through a table in the shared folder.

    Like a checkpoint it cuts the lineage; unlike one it does not hand on size estimates, which
    multiply with every join of an iteration.
    """
    path = scratch_path(frame.sparkSession, name)
    frame.write.option("compression", compression).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
