"""The raw files by table, and what became of each."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.contracts import RAW_TABLES, TableContract
from ordermill.sinks.counted import Written
from ordermill.sources.files import (
    CheckedCsv,
    path_exists,
    read_checked_csv,
)
from ordermill.sources.inference import read_inferred_csv

LOADED, MISSING, UNREADABLE = "loaded", "missing", "unreadable"


@dataclass(frozen=True)
class LoadResult:
    """Outcome for one table; ``written`` is known once the table is landed."""

    table: str
    status: str
    frame: DataFrame | None = None
    written: Written | None = None
    error: str | None = None


# A raw table as read: checked text, or the frame of an inferred scan.
RawRead = CheckedCsv | DataFrame


def raw_paths(root: str, pattern: str = "{table}.csv") -> dict[str, str]:
    """Path of every raw table; ``pattern`` may hold a glob."""
    return {c.name: f"{root.rstrip('/')}/{pattern.format(table=c.name)}" for c in RAW_TABLES}


def frame_of(read: RawRead) -> DataFrame:
    return read.text.select(*read.typed()) if isinstance(read, CheckedCsv) else read


def _source_error(read: RawRead) -> str | None:
    """What reading the source alone fails with, if it does."""
    frame = read.text if isinstance(read, CheckedCsv) else read
    try:
        # every cell is read, as a write would
        frame.agg(*[F.max(F.col(f"`{c}`").cast("string")) for c in frame.columns]).first()
    except Exception as error:  # nothing but the read has run
        return str(error)
    return None


def load_raw(
    spark: SparkSession,
    root: str,
    land: Callable[[RawRead, TableContract], tuple[DataFrame, Written]] | None = None,
    pattern: str = "{table}.csv",
    infer: bool = False,
    aliases: Mapping[str, Mapping[str, str]] | None = None,
) -> dict[str, LoadResult]:
    """Read every raw table found under ``root`` and hand it to ``land``.

    A missing folder gives an empty result, a missing file is marked and skipped, and a
    file that cannot be read, or whose header does not fit, is marked with its error. Where
    landing fails, the source is read once more by itself: if that works, the failure is the
    write's and goes to the caller. ``aliases`` gives header aliases by table.
    """
    if not path_exists(spark, root):
        return {}
    paths = raw_paths(root, pattern)
    return {
        c.name: _load_one(spark, c, paths[c.name], land, infer, (aliases or {}).get(c.name))
        for c in RAW_TABLES
    }


def _load_one(spark, contract, path, land, infer, aliases) -> LoadResult:
    if not path_exists(spark, path):
        return LoadResult(contract.name, MISSING)
    try:
        read = (
            read_inferred_csv(spark, path, contract.name)[0]
            if infer
            else read_checked_csv(spark, path, contract.schema, aliases)
        )
    except Exception as error:  # only the source has been read by now
        return LoadResult(contract.name, UNREADABLE, error=str(error))
    if land is None:
        return LoadResult(contract.name, LOADED, frame_of(read))
    try:
        landed, written = land(read, contract)
    except Exception:
        cause = _source_error(read)
        if cause is None:
            raise
        return LoadResult(contract.name, UNREADABLE, error=cause)
    return LoadResult(contract.name, LOADED, landed, written)


def loaded_frames(results: Mapping[str, LoadResult]) -> dict[str, DataFrame]:
    return {name: r.frame for name, r in results.items() if r.status == LOADED}
