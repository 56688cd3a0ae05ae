"""Row counts and other metrics taken while writing, so no second job is needed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Written:
    """What a write saw go by."""

    rows: int
    metrics: dict[str, int] = field(default_factory=dict)


def write_counted(
    df: DataFrame,
    write: Callable[[DataFrame], None],
    metrics: Mapping[str, Column] | None = None,
    columns: Sequence[Column | str] | None = None,
) -> Written:
    """Run ``write`` and return its row count and ``metrics``, all from that one action.

    The metrics may use columns that are not written: ``columns`` are chosen above them. They
    are taken right below the writer, in the result stage, where Spark counts every task once
    however often it is retried.
    """
    seen = Observation()
    wanted = metrics or {}
    observed = df.observe(
        seen,
        F.count(F.lit(1)).alias("_rows"),
        *[value.alias(name) for name, value in wanted.items()],
    )
    write(observed.select(*columns) if columns is not None else observed)
    # a write that did not run, such as "ignore" on a full table, sees nothing
    return Written(seen.get.get("_rows") or 0, {name: seen.get.get(name) or 0 for name in wanted})
