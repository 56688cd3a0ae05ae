"""Landing in increments: every run reads the raw files that no run before it has landed."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermill.contracts import LANDED_FILES, RAW_TABLES, REJECTS, TableContract
from ordermill.plans.jobs import BROKEN, REJECTED, LandingReport, landing_metrics
from ordermill.sinks.counted import Written
from ordermill.sinks.layers import PathLayers
from ordermill.sources.files import path_exists, read_checked_csv
from ordermill.sources.registry import LOADED, MISSING, UNREADABLE, LoadResult, raw_paths

_FILES = "path string, length bigint, modified timestamp"


def files_at(spark: SparkSession, glob: str) -> DataFrame:
    """path, length, modified of the files that match; their content is not read."""
    found = spark.read.format("binaryFile").load(glob)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def _ledger(spark: SparkSession, target: PathLayers, contract: TableContract) -> DataFrame:
    if not target.exists(spark, LANDED_FILES):
        return spark.createDataFrame([], LANDED_FILES.schema)
    return target.read(spark, LANDED_FILES).filter(F.col("table_name") == contract.name)


def _note(files: DataFrame, batch: str, contract: TableContract, target: PathLayers, done: bool):
    noted = files.select(
        F.lit(batch).alias("batch"),
        F.lit(contract.name).alias("table_name"),
        "path",
        "length",
        "modified",
        F.lit(done).alias("done"),
    )
    target.write(noted, LANDED_FILES, "append")


def _due(spark: SparkSession, glob: str, contract: TableContract, target: PathLayers) -> dict[str, DataFrame]:
    """The batches to land: one that a lost run planned and did not end, then the new files.

    A file that changed since it was landed is a new one. Spark's reader takes its files as a
    list, so the driver holds the paths of the files that are due, and no others.
    """
    ledger = _ledger(spark, target, contract)
    done = ledger.filter("done").select("batch").distinct()
    planned = ledger.filter("NOT done").join(done, "batch", "left_anti")
    due: dict[str, list] = {}
    for row in planned.select("batch", "path", "length", "modified").collect():
        due.setdefault(row.batch, []).append(row[1:])
    batches = {batch: spark.createDataFrame(files, _FILES) for batch, files in due.items()}
    new = files_at(spark, glob).join(ledger, ["path", "length", "modified"], "left_anti").collect()
    if new:
        batch = uuid.uuid4().hex
        batches[batch] = spark.createDataFrame(new, _FILES)
        _note(batches[batch], batch, contract, target, False)
    return batches


def _land(spark, batch: str, files: DataFrame, contract, target: PathLayers, aliases):
    paths = [r.path for r in files.select("path").orderBy("path").collect()]
    read = read_checked_csv(spark, paths, contract.schema, aliases)
    written = target.write_part(
        read.text, contract, batch, metrics=landing_metrics(read), columns=read.typed()
    )
    if any(n for name, n in written.metrics.items() if name == BROKEN or name.startswith(REJECTED)):
        target.write_part(read.rejects(contract.name), REJECTS, f"{contract.name}-{batch}")
    _note(files, batch, contract, target, True)
    return written


def land_increment(
    spark: SparkSession,
    root: str,
    target: PathLayers,
    pattern: str = "{table}*.csv",
    aliases: Mapping[str, Mapping[str, str]] | None = None,
) -> LandingReport:
    """Land the raw files that no earlier call has landed; the report tells of these alone.

    The ledger ``raw_data.landed_files`` holds each file with its length and time, first as
    planned, then as done. A batch is a part of its table that is written under the batch's name,
    so one that a lost run left open is landed again in its own place: every file counts once.
    A file that cannot be read leaves its batch open and its table as it was.
    """
    results = {}
    for contract in RAW_TABLES:
        glob = raw_paths(root, pattern)[contract.name]
        if not path_exists(spark, glob):
            results[contract.name] = LoadResult(contract.name, MISSING)
            continue
        batches = _due(spark, glob, contract, target)
        seen, error = [], None
        for batch, files in batches.items():
            try:
                seen.append(_land(spark, batch, files, contract, target, (aliases or {}).get(contract.name)))
            except Exception as failure:  # the write's own failures show in the next batch as well
                error = str(failure)
        metrics = Counter()
        for written in seen:
            metrics.update(written.metrics)
        results[contract.name] = LoadResult(
            contract.name,
            UNREADABLE if error else LOADED,
            target.read(spark, contract) if target.exists(spark, contract) else None,
            Written(sum(w.rows for w in seen), dict(metrics)),
            error,
        )
    return LandingReport(results)
