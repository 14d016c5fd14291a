"""Session helpers shared by every module."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

REPO_ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package even when the driver only changed ``sys.path``.

    On a cluster the package is shipped with ``--py-files`` or installed; the extra path entry is then unused.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if REPO_ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([REPO_ROOT, *parts])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; a table is a Parquet file or a directory of part files."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def local_session(app: str = "millrace", cores: str = "*", **conf: str) -> SparkSession:
    """Session for tests and for ``bench.py``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_worker_path(spark)
    return spark
