"""Data-quality rules. Each returns a frame of findings and never stops a job by itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ordermill.contracts import TableContract


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def key_label(keys: Sequence[str]) -> Column:
    """Printable key: the value itself, or all parts of a composite key as a JSON array."""
    if len(keys) == 1:
        return F.col(keys[0]).cast("string")
    return F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))


def null_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Nulls of every column of every table: one scan per table, one job for all."""

    def audit(table: str, df: DataFrame) -> DataFrame:
        counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
        pairs = F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("null_count"))
                for c in df.columns
            ]
        )
        return counted.select(F.lit(table).alias("table_name"), F.inline(pairs))

    return _union([audit(t, df) for t, df in frames.items()])


def null_audit(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Only the columns that hold nulls."""
    return null_counts(frames).filter(F.col("null_count") > 0)


def null_verdict(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: does any column hold a null, and how many columns do."""
    return (
        null_counts(frames)
        .groupBy("table_name")
        .agg(
            F.bool_or(F.col("null_count") > 0).alias("has_nulls"),
            F.count_if(F.col("null_count") > 0).alias("null_columns"),
        )
    )


def key_violations(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Primary-key values that are null in part or occur more than once."""
    has_null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .withColumn(
            "problem",
            F.when(has_null, "null").when(F.col("row_count") > 1, "duplicate"),
        )
        .filter(F.col("problem").isNotNull())
        .select(
            F.lit(table).alias("table_name"),
            key_label(keys).alias("key_value"),
            "problem",
            "row_count",
        )
    )


def primary_key_violations(
    frames: Mapping[str, DataFrame], contracts: Sequence[TableContract]
) -> DataFrame:
    return _union([key_violations(frames[c.name], c.name, c.primary_key) for c in contracts])


def orphans(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str, rule: str
) -> DataFrame:
    """Child keys without a parent, with the number of rows each concerns.

    A null key refers to nothing and is allowed. Child rows are counted per key before
    the anti-join, so a hot missing key moves as one row per map task.
    """
    keys = parent.select(F.col(parent_column).alias("_key"))
    return (
        child.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("_key"))
        .agg(F.count(F.lit(1)).alias("orphan_rows"))
        .join(keys, "_key", "left_anti")
        .select(
            F.lit(rule).alias("rule"),
            F.col("_key").cast("string").alias("key_value"),
            "orphan_rows",
        )
    )


def foreign_key_violations(
    frames: Mapping[str, DataFrame], contracts: Sequence[TableContract]
) -> DataFrame:
    return _union(
        [
            orphans(
                frames[c.name],
                fk.column,
                frames[fk.parent],
                fk.parent_column,
                f"{c.name}.{fk.column}->{fk.parent}.{fk.parent_column}",
            )
            for c in contracts
            for fk in c.foreign_keys
        ]
    )


def length_violations(
    df: DataFrame, table: str, keys: Sequence[str], limits: Mapping[str, int]
) -> DataFrame:
    """Strings longer than declared; one scan whatever the number of limits."""
    too_long = reduce(
        Column.__or__, [F.length(F.col(c).cast("string")) > n for c, n in limits.items()]
    )
    checks = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(n).alias("max_length"),
                F.length(F.col(c).cast("string")).alias("actual_length"),
            )
            for c, n in limits.items()
        ]
    )
    return df.filter(too_long).select(
        F.lit(table).alias("table_name"),
        key_label(keys).alias("key_value"),
        F.inline(F.filter(checks, lambda x: x["actual_length"] > x["max_length"])),
    )


def decimal_violations(
    df: DataFrame, table: str, keys: Sequence[str], types: Mapping[str, DecimalType]
) -> DataFrame:
    """Values that do not fit the declared DECIMAL(p, s) after rounding to its scale.

    They are reported as their text; text that is no number is one of them.
    """
    overflows = {
        c: F.col(c).isNotNull() & F.col(c).try_cast(t).isNull() for c, t in types.items()
    }
    checks = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit(t.simpleString()).alias("declared_type"),
                F.col(c).cast("string").alias("value"),
                overflows[c].alias("overflows"),
            )
            for c, t in types.items()
        ]
    )
    return df.filter(reduce(Column.__or__, overflows.values())).select(
        F.lit(table).alias("table_name"),
        key_label(keys).alias("key_value"),
        F.inline(F.filter(checks, lambda x: x["overflows"])),
    ).drop("overflows")


def row_findings(df: DataFrame, contract: TableContract) -> DataFrame:
    """Breaches that a row shows by itself, lengths and decimal ranges: one scan for all rules."""
    nothing = F.lit(None).cast("string")
    checks = []
    for column, most in contract.max_lengths.items():
        size = F.length(F.col(column).cast("string"))
        problem = F.concat_ws(" > ", size, F.lit(most))
        checks.append(("length", column, size > most, problem))
    for column, declared in contract.decimals.items():
        value = F.col(column)
        problem = F.concat_ws(" is no ", value.cast("string"), F.lit(declared.simpleString()))
        bad = value.isNotNull() & value.try_cast(declared).isNull()
        checks.append(("decimal", column, bad, problem))
    found = F.array(
        *[
            F.when(
                F.coalesce(bad, F.lit(False)),
                F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column_name"), problem.alias("problem")),
            )
            for rule, column, bad, problem in checks
        ]
    )
    listed = df.select(
        F.lit(contract.name).alias("table_name"),
        (key_label(contract.primary_key) if contract.primary_key else nothing).alias("key_value"),
        F.inline(F.filter(found, lambda x: x.isNotNull())),
    )
    return listed.select(
        "rule",
        "table_name",
        "key_value",
        "column_name",
        "problem",
        F.lit(1).cast("bigint").alias("row_count"),
    )


def contract_findings(
    frames: Mapping[str, DataFrame], contracts: Sequence[TableContract]
) -> DataFrame:
    """Every breach of keys, references, lengths and decimal ranges, in one shape.

    A table is scanned once for all rules that a row shows by itself, once for its primary key,
    and once for a reference that does not begin that key. Key counts serve twice where they
    can: as parents of other tables and, summed up, as children.
    """
    nothing = F.lit(None).cast("string")
    keys = {
        c.name: frames[c.name].groupBy(*c.primary_key).agg(F.count(F.lit(1)).alias("row_count"))
        for c in contracts
        if c.primary_key
    }
    parts = []
    for c in contracts:
        if c.name in keys:
            has_null = reduce(Column.__or__, [F.col(k).isNull() for k in c.primary_key])
            problem = F.when(has_null, "null").when(F.col("row_count") > 1, "duplicate")
            parts.append(
                keys[c.name]
                .select(
                    F.lit("primary_key").alias("rule"),
                    F.lit(c.name).alias("table_name"),
                    key_label(c.primary_key).alias("key_value"),
                    nothing.alias("column_name"),
                    problem.alias("problem"),
                    "row_count",
                )
                .filter("problem IS NOT NULL")
            )
        for fk in c.foreign_keys:
            if fk.parent not in frames:
                continue
            one = F.count(F.lit(1)).alias("row_count")
            known = keys.get(fk.parent, frames[fk.parent].groupBy(fk.parent_column).agg(one))
            if fk.column in c.primary_key:
                child, rows = keys[c.name], F.sum("row_count")
            else:
                child, rows = frames[c.name], F.count(F.lit(1))
            # conditions that stay above the key counts, so that the counts can be shared
            listed = child.groupBy(F.col(fk.column).alias("_key")).agg(rows.alias("row_count"))
            parent = known.filter("row_count > 0").select(F.col(fk.parent_column).alias("_parent"))
            parts.append(
                listed.filter(F.when(F.col("_key").isNotNull(), F.col("row_count")) > 0)
                .join(parent, F.col("_key").eqNullSafe(F.col("_parent")), "left_anti")
                .select(
                    F.lit("foreign_key").alias("rule"),
                    F.lit(c.name).alias("table_name"),
                    F.col("_key").cast("string").alias("key_value"),
                    F.lit(fk.column).alias("column_name"),
                    F.lit(f"{c.name}.{fk.column}->{fk.parent}.{fk.parent_column}").alias("problem"),
                    "row_count",
                )
            )
        if c.max_lengths or c.decimals:
            parts.append(row_findings(frames[c.name], c))
    return _union(parts)


def conform(df: DataFrame, contract: TableContract, keep: Sequence[str] = ()) -> DataFrame:
    """Shape a frame as its contract declares: renamed, cast, ordered and stamped.

    Columns named in ``keep`` follow as they are.

    A double that becomes a decimal is rounded half up on its decimal digits.
    """
    source = {contract.renames.get(c, c): c for c in df.columns}
    columns = []
    for f in contract.schema.fields:
        if f.name in source:
            value = F.col(source[f.name])
            if f.name in contract.stamped:
                value = F.coalesce(value.cast(f.dataType), F.current_timestamp())
        elif f.name in contract.stamped:
            value = F.current_timestamp()
        else:
            raise ValueError(f"{contract.qualified_name}: no column for {f.name}")
        columns.append(value.cast(f.dataType).alias(f.name, metadata=f.metadata))
    return df.select(*columns, *keep)
