"""Places of rows within ordered groups of any size, one of which may hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

_PART, _SALT = "_part", "_salt"


def _number(offsets: dict[int, int], group: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, place, fresh = None, 0, True
        for batch in batches:
            places = []
            groups, parts = batch.column(group).to_pylist(), batch.column(_PART).to_pylist()
            for key, part in zip(groups, parts, strict=True):
                if fresh or key != current:
                    # only a partition's first group can have begun in an earlier one
                    place = offsets.get(part, 0) if fresh else 0
                    current, fresh = key, False
                places.append(place)
                place += 1
            kept = [n for n in batch.schema.names if n != _PART]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(places, pa.int64())], [*kept, "pos"]
            )

    return run


def positions(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``pos``, their place from 0 within ``group``, ascending, nulls first.

    One range sort by group and order spreads a large group over many partitions, which rest in
    the shared folder. Rows are then numbered where they lie; the driver sends one offset per
    partition, for the group it opens with. Rows equal in all keys are told apart by where
    they were read, so a repeated row does not fill a partition either.
    """
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)] + [F.col(_SALT)]
    dealt = (
        rows.withColumn(_SALT, F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop(_SALT)
        .withColumn(_PART, F.spark_partition_id())
        .checkpoint()
    )
    earlier = Window.partitionBy(group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    opening = (
        dealt.groupBy(group, _PART)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("offset", F.sum("n").over(earlier))
        .filter("offset > 0")
        .select(_PART, "offset")
    )
    offsets = {r[_PART]: r.offset for r in opening.collect()}
    schema = StructType([*rows.schema.fields]).add("pos", LongType())
    return dealt.mapInArrow(_number(offsets, group), schema)
