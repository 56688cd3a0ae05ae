"""Exact distinct counts that can be merged: bitmaps over dense whole numbers.

A group's members are bits in bitmaps of 32,768 numbers each, which are combined by OR. So counts
per day roll up to weeks and months without a look at the rows, and new rows are merged in. Rows
shrink to one bitmap per (group, bucket) and task before they move, and a large group spreads over
its buckets. Numbers must be dense: a bucket takes 4 KB however few it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.operators.ranking import with_position


def member_bitmaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """keys, bucket, bitmap of the numbers that occur with each key; a null number is none."""
    return (
        df.filter(F.col(number).isNotNull())
        .groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap"))
    )


def merge_bitmaps(bitmaps: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Bitmaps of coarser keys, or of several sets of bitmaps put together by ``union``."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def members(bitmaps: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Exact number of members per key; the bitmaps must be merged by the same keys."""
    return bitmaps.groupBy(*keys).agg(F.sum(F.bitmap_count("bitmap")).cast("bigint").alias(name))


def dense_numbers(values: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """(column, number) for every value: those of ``known`` keep theirs, new ones follow from 1 on.

    ``known`` is an earlier result of this function.
    """
    distinct = values.select(column).filter(F.col(column).isNotNull()).distinct()
    if known is None:
        return with_position(distinct, [F.col(column)], "number")
    last = known.agg(F.coalesce(F.max("number"), F.lit(0)).alias("last")).first().last
    new = with_position(distinct.join(known, column, "left_anti"), [F.col(column)], "number")
    return known.select(column, "number").union(new.select(column, F.col("number") + last))
