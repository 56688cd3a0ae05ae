"""Appends that can be repeated."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermill.contracts import TableContract
from ordermill.operators.ranking import top_per_group
from ordermill.sinks.counted import Written
from ordermill.sinks.layers import Layers

# Keys of a batch that are listed in the look-up; 10,000 keys of 32 bytes are some 300 KB.
LISTED = 10_000


def held_keys(df: DataFrame, contract: TableContract, target: Layers) -> DataFrame:
    """The target's keys that rows of ``df`` may meet.

    The first key column of a batch of up to LISTED keys goes to the target's scan as a list:
    Parquet skips row groups whose Bloom filter holds none of them, a database uses its index.
    So a small batch costs what it holds, however long the history. A larger batch meets the
    keys of the whole target.
    """
    held = target.read(df.sparkSession, contract)
    first = contract.primary_key[0]
    values = [r[0] for r in df.select(first).distinct().limit(LISTED + 1).collect()]
    if len(values) <= LISTED:
        inside = F.col(first).isin([v for v in values if v is not None])
        held = held.filter(inside | F.col(first).isNull() if None in values else inside)
    return held.select(*[F.col(k).alias(f"_held_{k}") for k in contract.primary_key])


def append_missing(df: DataFrame, contract: TableContract, target: Layers) -> Written:
    """Append the rows whose primary key the target does not hold yet, one per key.

    Repeating an append adds nothing; a null key equals a null key. Of repeats that differ
    the one that is last in the order of the other columns is kept. Repeated keys are dropped
    map-side before they move. It also serves database tables that a foreign key refers to,
    which can be neither dropped nor truncated.
    """
    keys = list(contract.primary_key)
    others = [F.desc_nulls_last(c) for c in df.columns if c not in keys] or [F.lit(0)]
    fresh = top_per_group(df, keys, others)
    if target.exists(df.sparkSession, contract):
        held = held_keys(df, contract, target)
        same: Column = reduce(
            Column.__and__, [F.col(k).eqNullSafe(F.col(f"_held_{k}")) for k in keys]
        )
        fresh = fresh.join(held, same, "left_anti")
    return target.write(fresh.select(*df.columns), contract, "append")
