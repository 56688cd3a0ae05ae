"""Where the operators' inputs are."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ordermill.session import scratch_root

TOKENIZERS = "/opt/tokenizers"


def prepare(spark: SparkSession) -> None:
    """Name the shared folder, and where Python workers find this package.

    Workers on a cluster get it by ``--py-files``; where the repository is merely on the
    driver's path, as in local mode, they are told that path.
    """
    scratch_root(spark)
    root = str(Path(__file__).parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the installed package knows, else its usual folder."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)
