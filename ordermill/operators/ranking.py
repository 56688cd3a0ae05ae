"""Ranks within groups, top rows per group, and positions in a global order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermill.operators.aggregates import category_counts
from ordermill.session import scratch_root


def category_preference() -> list[Column]:
    """Most lines first; ties by category name, the null category last."""
    return [F.desc("category_orders"), F.asc_nulls_last("product_category_name")]


def by_date() -> list[Column]:
    """Presentation order of daily sales."""
    return [F.asc_nulls_first("sale_date")]


def by_revenue() -> list[Column]:
    """Presentation order of product performance; ties by product."""
    return [F.desc_nulls_last("total_revenue"), F.asc("product_id")]


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn"
) -> DataFrame:
    """Row number within each group. ``order`` must be total for a stable result."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1
) -> DataFrame:
    """First ``n`` rows of each group.

    Spark limits every group within each map task before the shuffle, so a hot group
    sends at most ``n`` rows per task.
    """
    return rank_within(df, keys, order, "_rank").filter(F.col("_rank") <= n).drop("_rank")


def favorite_category(details: DataFrame) -> DataFrame:
    """The category each customer bought most lines of."""
    return top_per_group(
        category_counts(details), ["customer_id"], category_preference()
    ).select("customer_id", F.col("product_category_name").alias("favorite_category"))


def with_position(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Sort globally and number the rows 1..n without gathering them in one task.

    The range-sorted rows are checkpointed, so numbering reads one fixed layout even if
    executors are lost. Each task numbers its own rows; the broadcast side holds one row
    per sorted partition, so its size is bounded by the partition count, not the data.
    """
    scratch_root(df.sparkSession)
    row_id = F.monotonically_increasing_id()
    placed = (
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        # the id holds the partition in its upper 31 bits and the row in its lower 33
        .withColumn("_row", row_id.bitwiseAND(F.lit((1 << 33) - 1)))
        .checkpoint()
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_offset") + F.col("_row") + 1).alias(name)
    )
