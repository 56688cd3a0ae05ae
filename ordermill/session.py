"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings the plans in this package count on. The skew settings split a
# hot order, product or customer at run time; forceOptimizeSkewedJoin lets Spark do so
# even where the split costs one more shuffle (only paid when a partition is skewed).
# A task holds the keys of what it reads, some ten times its size at rest, and more than once
# where it joins and sums up; so what it reads is bounded, however few tasks could share a stage.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.files.maxPartitionBytes": "32MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Live-order keys are kept for the life of the stream; RocksDB holds them off-heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def build_session(
    app_name: str,
    master: str | None = None,
    initial_partitions: int | None = None,
    **settings: str,
) -> SparkSession:
    """A UTC session with the runtime settings; ``settings`` override them.

    ``initial_partitions`` is the number of partitions every shuffle starts with, before
    adaptive execution merges the small ones: set it for the largest shuffle of the job, at
    some 16 MB of shuffled data each, or up to 128 MB with the memory for it (100 TB: 800,000;
    unset: Spark's own 200). It is fixed at
    the start of the session, so plans do not depend on what was built before them.

    Call-site capture is off: it costs several driver round trips per column expression.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    merged = {
        "spark.sql.session.timeZone": "UTC",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **RUNTIME_SETTINGS,
        **({INITIAL_PARTITIONS: str(initial_partitions)} if initial_partitions else {}),
        **settings,
    }
    for key, value in merged.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def adapt(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a caller's session where the caller set none."""
    chosen = spark.conf.getAll
    for key, value in RUNTIME_SETTINGS.items():
        if key not in chosen:
            spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    A machine-local folder is used only in local mode, where driver and executors are
    one process.
    """
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if shared:
        if not context.getCheckpointDir():
            context.setCheckpointDir(shared)
        return shared
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="ordermill-")
    # results are lazy, so what they read goes with the process that made it
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    context.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, on whatever file system it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
