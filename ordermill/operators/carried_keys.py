"""Key rules for new rows: a landing is checked against stored key counts, not old rows.

Every batch writes one part with its key counts and counts of references. Written again, a part
takes its own place, so a repeated batch counts once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.contracts import KEY_COUNTS, TableContract
from ordermill.operators.quality import key_label
from ordermill.sinks.layers import PathLayers

KEY = "key"


def key_counts(frames: Mapping[str, DataFrame], contracts: Sequence[TableContract]) -> DataFrame:
    """rule, key_value, has_null, row_count: rows per primary key and per reference of a batch."""
    parts = []
    for c in contracts:
        if c.name not in frames:
            continue
        has_null = reduce(Column.__or__, [F.col(k).isNull() for k in c.primary_key])
        rules = [(f"{KEY} {c.name}", key_label(c.primary_key), has_null)]
        rules += [
            (f"{c.name}.{fk.column}->{fk.parent}.{fk.parent_column}", F.col(fk.column).cast("string"), F.lit(False))
            for fk in c.foreign_keys
        ]
        for rule, value, null in rules:
            rows = frames[c.name].select(value.alias("key_value"), null.alias("has_null"))
            if not rule.startswith(KEY):
                rows = rows.filter("key_value IS NOT NULL")
            parts.append(
                rows.groupBy("key_value", "has_null")
                .agg(F.count(F.lit(1)).alias("row_count"))
                .select(F.lit(rule).alias("rule"), "key_value", "has_null", "row_count")
            )
    return reduce(DataFrame.union, parts)


def note_keys(
    batch: str, frames: Mapping[str, DataFrame], contracts: Sequence[TableContract], target: PathLayers
) -> None:
    """Store the key counts of a named batch of new rows."""
    target.write_part(key_counts(frames, contracts), KEY_COUNTS, batch)


def _totals(spark: SparkSession, target: PathLayers, batch: str | None) -> DataFrame:
    stored = target.read(spark, KEY_COUNTS)
    if batch is not None:
        own = target.read_part(spark, KEY_COUNTS, batch).select("rule", "key_value").distinct()
        same = stored["rule"].eqNullSafe(own["rule"]) & stored["key_value"].eqNullSafe(own["key_value"])
        stored = stored.join(own, same, "left_semi")
    return stored.groupBy("rule", "key_value", "has_null").agg(F.sum("row_count").alias("row_count"))


def key_problems(spark: SparkSession, target: PathLayers, batch: str | None = None) -> DataFrame:
    """Primary keys that are null in part or occur more than once among all rows so far.

    With ``batch``, only keys that occur in it: what that landing has to answer for.
    """
    found = _totals(spark, target, batch).filter(F.col("rule").startswith(f"{KEY} "))
    problem = F.when(F.col("has_null"), "null").when(F.col("row_count") > 1, "duplicate")
    return found.select(
        F.substring_index("rule", " ", -1).alias("table_name"),
        "key_value",
        problem.alias("problem"),
        "row_count",
    ).filter("problem IS NOT NULL")


def missing_parents(spark: SparkSession, target: PathLayers, batch: str | None = None) -> DataFrame:
    """References without a parent among all rows so far, with the rows they concern."""
    parents = (
        target.read(spark, KEY_COUNTS)
        .filter(F.col("rule").startswith(f"{KEY} "))
        .select(F.substring_index("rule", " ", -1).alias("parent"), "key_value")
    )
    wanted = _totals(spark, target, batch).filter(~F.col("rule").startswith(f"{KEY} "))
    parent = F.substring_index(F.substring_index("rule", "->", -1), ".", 1)
    return (
        wanted.withColumn("parent", parent)
        .join(parents, ["parent", "key_value"], "left_anti")
        .select("rule", "key_value", F.col("row_count").alias("orphan_rows"))
    )
